"""Reports of one story grouped into incidents."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from murmura import rules as R
from murmura.functions.common import outlet_of
from murmura.operators.components import components
from murmura.scratch import by_shuffle, materialize


@F.pandas_udf(DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)])


def headline(title: Column) -> Column:
    """Title without an outlet suffix of up to 40 characters."""
    outlet = F.coalesce(outlet_of(title), F.lit(""))
    return F.when((outlet != "") & (F.length(outlet) <= 40), F.regexp_extract(title, r"^(?s)(.*) - (.*)$", 1)).otherwise(title)


def story_words(text: Column) -> Column:
    """Distinct canonical words of a headline: stop words and short words dropped, plural s cut."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    same = F.create_map(*[F.lit(x) for kv in R.SAME_MOVE.items() for x in kv])
    stops, canon = F.array(*map(F.lit, R.INCIDENT_STOP_WORDS)), F.array(*map(F.lit, R.SAME_MOVE))
    words = F.transform(words, lambda w: F.coalesce(F.element_at(same, w), w))
    words = F.filter(words, lambda w: ~F.array_contains(stops, w) & ((F.length(w) >= 3) | w.rlike("^[0-9]+$")))
    cut = lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~F.array_contains(canon, w), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(words, cut))


def incident_sets(items: DataFrame) -> DataFrame:
    """``items`` with title and event as sorted arrays of their distinct story words, less those like the entity's name; likeness
    is computed once for each distinct (word, name), and items keep their row."""
    rest = [c for c in items.columns if c not in ("title", "event")]
    both = items.select(*rest, story_words(headline(F.col("title"))).alias("title"), story_words(F.col("event")).alias("event"))
    pairs = both.select("entity_name", F.explode(F.array_union("title", "event")).alias("token")).distinct()
    words = F.filter(F.split(F.lower("entity_name"), r"(?U)\W+"), lambda w: w != "")
    names = F.array_append(F.filter(words, lambda w: F.length(w) >= 4), F.array_join(words, ""))
    alike = pairs.select("entity_name", "token", F.explode(names).alias("name")).where(difflib_ratio("token", "name") >= R.ENTITY_WORD_RATIO)
    alike = alike.groupBy(F.col("entity_name").alias("_n")).agg(F.collect_set("token").alias("_alike"))
    rows = both.join(by_shuffle(alike), F.col("entity_name").eqNullSafe(F.col("_n")), "left")
    less = lambda c: F.array_sort(F.array_except(c, F.coalesce("_alike", F.array().cast("array<string>")))).alias(c)
    return rows.select(*rest, less("title"), less("event"))


def incident_tokens(items: DataFrame) -> DataFrame:
    """item_id, entity_id, kind (title or event), token of every story word of `incident_sets`."""
    sets = incident_sets(items.select("item_id", "entity_id", "entity_name", "title", "event"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("words")) for k in ("title", "event")))).alias("s")
    return sets.select("item_id", "entity_id", kinds).select("item_id", "entity_id", "s.kind", F.explode("s.words").alias("token"))


def story_runs(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, members): items of one entity with equal word sets, chained over gaps of at most INCIDENT_DAYS, are one run.

    runs: run (its smallest item), entity_id, title and event (sorted words), start, end (null: undated). members: item_id,
    run. Equal reports are one story wherever their words could link them at all; items whose words can't are left out.
    Two runs are near if their spans are within the gap: then some two of their items are."""
    rows = sets.select("item_id", "entity_id", F.col("published_at").cast("timestamp").cast("double").alias("at"), "title", "event")
    rows = materialize(rows.where((F.size("title") >= R.TITLE_SHARED) | (F.size("event") > 0)), "story-items")
    key = ["entity_id", "title", "event"]
    # Tasks reduce a story to its distinct times before the shuffle.
    times = rows.groupBy(*key, "at").agg(F.min("item_id").alias("item_id"))
    before = F.lag("at").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("at")))
    begins = F.when(F.col("at") - before <= R.INCIDENT_DAYS * 86400, 0).otherwise(1)
    times = times.withColumn("begins", begins).withColumn("k", F.sum("begins").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("at"))))
    w = Window.partitionBy(*key, "k")
    times = materialize(times.select(*key, "at", F.min("item_id").over(w).alias("run"), F.min("at").over(w).alias("start"), F.max("at").over(w).alias("end")), "story-times")
    same = [rows[c] == times[c] for c in key] + [rows["at"].eqNullSafe(times["at"])]
    return times.select("run", *key, "start", "end").distinct(), rows.join(by_shuffle(times), same).select(rows["item_id"], "run")


#: Rows of one key that meet in one task at most: keys of more are dealt as pairs of blocks.
BLOCK = 2048


def _rare_keys(runs: DataFrame, kind: str, least: Column, together: int) -> DataFrame:
    """run, entity_id, kind, key, n (tokens), k: every ``together`` of the rarest tokens of a run, k the place of the last.

    Two sets that share s tokens share ``together`` of the rarest n - s + ``together`` of each (s is at least ``least``, and
    ``together`` no more than that); rarity is counted within the entity, in one order for all its runs."""
    tokens = runs.select("run", "entity_id", F.size(kind).alias("n"), F.explode(kind).alias("token"))
    rarity = tokens.groupBy("entity_id", "token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("df", "token"))
    rare = tokens.join(by_shuffle(rarity), ["entity_id", "token"]).withColumn("place", place).where(F.col("place") <= F.col("n") - least + together)
    listed = rare.groupBy("run", "entity_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("rarest"))
    if together == 1:
        keyed = listed.select("run", "entity_id", "n", F.posexplode("rarest").alias("k", "key")).withColumn("k", F.col("k") + 1)
    else:
        later = listed.select("run", "entity_id", "n", "rarest", F.posexplode("rarest").alias("k", "token")).where("k > 0")
        keyed = later.select("run", "entity_id", "n", (F.col("k") + 1).alias("k"), F.explode(F.transform(F.slice("rarest", F.lit(1), F.col("k")), lambda t: F.concat_ws(" ", t, "token"))).alias("key"))
    return keyed.withColumn("kind", F.lit(kind))


def _met(left: DataFrame, right: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """a, b of the rows of ``left`` and ``right`` (run, n, k) that share ``keys`` and fit.

    A key of more than BLOCK rows on a side is dealt: its rows go to blocks by a hash, each block of the left with each of the
    right, so that no task reads more of it than two blocks."""
    sized = right.groupBy(*keys).agg(F.count("*").alias("m")).join(by_shuffle(left.groupBy(*keys).agg(F.count("*").alias("l"))), keys)
    heavy = materialize(sized.where((F.col("m") > BLOCK) | (F.col("l") > BLOCK)).select(*keys, F.ceil(F.col("l") / BLOCK).cast("int").alias("la"), F.ceil(F.col("m") / BLOCK).cast("int").alias("lb")), "story-heavy-keys")
    side = lambda df, x: df.select(*keys, F.col("run").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"), F.hash("run").alias(f"h{x}"))
    x, y = side(left, "a"), side(right, "b")
    found = x.join(heavy, keys, "left_anti").join(by_shuffle(y), keys).where(fits)
    found = found.select("a", "b")
    if not heavy.isEmpty():
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = x.join(heavy, keys).withColumns({"ba": F.pmod("ha", "la"), "bb": every("lb")}).drop("la", "lb")
        y = y.join(heavy, keys).withColumns({"bb": F.pmod("hb", "lb"), "ba": every("la")}).drop("la", "lb")
        found = found.unionByName(x.join(by_shuffle(y), [*keys, "ba", "bb"]).where(fits).select("a", "b"))
    return found


def same_story_pairs(runs: DataFrame) -> DataFrame:
    """Pairs (a < b) of runs of one entity that report one story.

    Exact prefix filter: titles must share several tokens, so they meet over pairs of their rarest ones, events over single
    ones, within neighbouring spans of the largest gap (undated runs with all); pairs are verified once on their whole sets."""
    least = {"title": F.lit(R.TITLE_SHARED), "event": F.least(F.ceil(F.col("n") / 2), F.lit(R.EVENT_SHARED))}
    together = {"title": 2, "event": 1}
    smaller = F.least("na", "nb")
    needed = F.when(F.col("kind") == "title", F.greatest(F.lit(R.TITLE_SHARED), F.ceil(smaller * R.TITLE_OVERLAP - 1e-9)) - together["title"]).otherwise(
        F.least(F.ceil((F.col("na") + F.col("nb")) * R.EVENT_JACCARD / (1 + R.EVENT_JACCARD) - 1e-9), F.greatest(F.lit(R.EVENT_SHARED), F.ceil(smaller * R.EVENT_OVERLAP - 1e-9))) - together["event"]
    )
    width = R.INCIDENT_DAYS * 86400
    span = lambda c: F.floor(F.col(c) / width)
    rows = None
    for kind in ("title", "event"):
        keyed = _rare_keys(runs, kind, least[kind], together[kind])
        rows = keyed if rows is None else rows.unionByName(keyed)
    rows = materialize(rows.join(by_shuffle(runs.select("run", "start", "end")), "run"), "story-keys")
    dated, undated = rows.where("start IS NOT NULL"), rows.where("start IS NULL")
    near = lambda df, a, b: df.withColumn("span", F.explode(F.sequence(a, b)))
    every = lambda df: df.withColumn("span", F.lit(None).cast("long"))
    left = near(dated, span("start"), span("end")).unionByName(every(undated)).withColumn("span", F.coalesce("span", F.lit(-(1 << 62))))
    right = near(dated, span("start") - 1, span("end") + 1).unionByName(every(rows)).withColumn("span", F.coalesce("span", F.lit(-(1 << 62))))
    fits = (F.col("a") != F.col("b")) & (F.col("ka") <= F.col("na") - needed) & (F.col("kb") <= F.col("nb") - needed)
    met = _met(left, right, ["entity_id", "kind", "key", "span"], fits)
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = runs.toDF(*(f"a_{c}" for c in runs.columns)).withColumnRenamed("a_run", "a")
    y = runs.toDF(*(f"b_{c}" for c in runs.columns)).withColumnRenamed("b_run", "b")
    both = found.join(by_shuffle(x), "a").join(by_shuffle(y), "b")
    close = F.coalesce((F.col("a_start") <= F.col("b_end") + width) & (F.col("b_start") <= F.col("a_end") + width), F.lit(True))
    share = lambda k: (F.size(F.array_intersect(f"a_{k}", f"b_{k}")), F.size(f"a_{k}"), F.size(f"b_{k}"))
    (t, ta, tb), (e, ea, eb) = share("title"), share("event")
    title = (t >= R.TITLE_SHARED) & (t / F.least(ta, tb) >= R.TITLE_OVERLAP)
    event = (e > 0) & ((e / (ea + eb - e) >= R.EVENT_JACCARD) | ((e >= R.EVENT_SHARED) & (e / F.least(ea, eb) >= R.EVENT_OVERLAP)))
    return both.where(close & (title | event)).select("a", "b", F.col("a_entity_id").alias("entity_id"))


def incidents(items: DataFrame) -> DataFrame:
    """item_id, incident_id (smallest item of the incident) of every item (item_id, entity_id, entity_name, title, event,
    published_at)."""
    items = materialize(items.select("item_id", "entity_id", "entity_name", "title", "event", "published_at"), "incident-items")
    runs, members = story_runs(incident_sets(items))
    runs = materialize(runs, "story-runs")
    found = components(same_story_pairs(runs), near="entity_id").distinct().toDF("run", "root")
    placed = members.join(by_shuffle(found), "run", "left").select("item_id", F.coalesce("root", "run").alias("incident_id"))
    return items.select("item_id").join(by_shuffle(placed), "item_id", "left").select("item_id", F.coalesce("incident_id", "item_id").alias("incident_id"))


def collapsed_by_incident(items: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each incident: its item of the highest score (smallest id on ties) leads, with the number of the others
    and the ids of up to twenty of them by score."""
    rows = items.join(by_shuffle(groups), "item_id").withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "item_id")))
    return rows.groupBy("incident_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("item_id"))).alias("lead"), F.max("score").alias("score"), (F.count("*") - 1).alias("others"),
        F.array_sort(F.collect_list(F.when(F.col("place").between(2, 21), F.struct("place", "item_id")))).alias("shown"),
    ).withColumn("shown", F.transform("shown", lambda x: x["item_id"]))


def incident_menu(summary: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` incidents of the highest score, then most items, then by title."""
    return summary.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc("items"), "lead_title", "incident_id").limit(n)


def incident_summary(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Per incident: items, outlets (own item where unknown), lead title by score, highest score."""
    rows = items.join(by_shuffle(groups), "item_id")
    return rows.groupBy("incident_id").agg(
        F.count("*").alias("items"), F.countDistinct(F.coalesce(outlet_of(F.col("title")), F.concat(F.lit("item:"), F.col("item_id").cast("string")))).alias("outlets"),
        F.min_by("title", F.struct(-F.col("score"), F.col("item_id"))).alias("lead_title"), F.max("score").alias("score"),
    )


def _edits(limit: Column, a: Column, b: Column) -> Column:
    """Letters to insert or delete at most between names of lengths a and b whose likeness reaches ``limit``.

    The blocks that likeness r counts follow one another in both names, so r (a + b) / 2 letters stay and the others go or
    come; their number is odd or even as a + b is."""
    most = F.floor((F.lit(1.0) - limit) * (a + b) + 1e-6).cast("int")
    return most - (most + a + b) % 2


def likely_pairs(left: DataFrame, right: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """Pairs (keys, name, other) of the distinct lower-case ``name`` of ``left`` and ``other`` of ``right`` that share ``keys``
    and may reach a likeness of ``limit``, a column over ``keys``; no such pair is lost.

    Names of lengths a and b differ in at most k inserted and deleted letters (see `_edits`). ``other`` is cut into k + 1 segments
    for each length that a partner may have; at least one stands whole in the partner, moved by no more than the edits before and
    after it allow. Names meet over such segments and their place; what has more than k edits by Levenshtein's count goes."""
    x = left.select(*keys, "name").distinct().withColumn("la", F.length("name")).where("la > 0")
    y = right.select(*keys, "other").distinct().withColumn("lb", F.length("other")).where("lb > 0")
    la, lb = F.col("la"), F.col("lb")
    low, high = limit / (F.lit(2.0) - limit), (F.lit(2.0) - limit) / limit
    lengths = lambda own: F.sequence(F.greatest(F.ceil(own * low - 1e-6), F.lit(1)).cast("int"), F.greatest(F.floor(own * high + 1e-6), F.lit(1)).cast("int"))
    cut = lambda df: df.withColumn("edits", _edits(limit, la, lb)).where("edits >= abs(la - lb)").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("edits") + 1)))
    short = F.floor(lb / (F.col("edits") + 1)).cast("int")
    longer = lb % (F.col("edits") + 1)  # so many last segments are longer by one
    before = F.greatest(F.col("i") - 1 - (F.col("edits") + 1 - longer), F.lit(0))
    at, width = (F.col("i") - 1) * short + before, short + (F.col("i") > F.col("edits") + 1 - longer).cast("int")
    held = cut(y.withColumn("la", F.explode(lengths(lb)))).withColumn("part", F.substr("other", at + 1, width))
    moved = la - lb
    first, last = F.greatest(1 - F.col("i"), moved - (F.col("edits") + 1 - F.col("i"))), F.least(F.col("i") - 1, moved + (F.col("edits") + 1 - F.col("i")))
    sought = cut(x.withColumn("lb", F.explode(lengths(la)))).withColumns({"at": at, "width": width, "first": first, "last": last}).where("first <= last")
    sought = sought.withColumn("from", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("last") + F.col("at")))).where("from >= 0 AND from + width <= la").withColumn("part", F.substr("name", F.col("from") + 1, F.col("width")))
    on = [*keys, "la", "lb", "i", "part"]
    met = sought.select(*on, "name", "edits").join(by_shuffle(held.select(*on, "other")), on).where(F.levenshtein("name", "other") <= F.col("edits"))
    return met.select(*keys, "name", "other").distinct()


def near_duplicate_names(candidates: DataFrame, tracked: DataFrame, *, person: float = 0.93, other: float = 0.88, head: float = 0.85) -> DataFrame:
    """Candidate and tracked names (client_id, name, kind) of one client and kind that are too alike: client_id, kind, name,
    tracked, ratio and basis.

    basis name: the likeness of the whole names reaches ``person`` or ``other`` (from five letters on); basis head: first
    words of five letters or more that differ reach ``head`` (a misspelt company)."""
    keys = ["client_id", "kind"]
    limit = F.when(F.col("kind") == "person", person).otherwise(other)
    low = lambda df, c: df.select(*keys, F.col("name").alias(f"{c}_name"), F.lower("name").alias(c))
    x, y = low(candidates, "name").distinct(), low(tracked, "other").distinct()
    long = (F.col("kind") == "person") | ((F.length("name") >= 5) & (F.length("other") >= 5))
    pairs = likely_pairs(x, y, keys, limit).where(long).withColumn("ratio", difflib_ratio("name", "other")).where(F.col("ratio") >= limit)
    whole = pairs.join(by_shuffle(x), [*keys, "name"]).join(by_shuffle(y), [*keys, "other"]).select(*keys, F.col("name_name").alias("name"), F.col("other_name").alias("tracked"), "ratio", F.lit("name").alias("basis"))
    first = lambda df, c: df.where("kind <> 'person'").withColumn(c, F.split(F.col(c), " ")[0]).where(F.length(c) >= 5)
    hx, hy = first(x, "name"), first(y, "other")
    heads = likely_pairs(hx, hy, keys, F.lit(head)).where("name <> other").withColumn("ratio", difflib_ratio("name", "other")).where(F.col("ratio") >= head)
    by_head = heads.join(by_shuffle(hx), [*keys, "name"]).join(by_shuffle(hy), [*keys, "other"]).select(*keys, F.col("name_name").alias("name"), F.col("other_name").alias("tracked"), "ratio", F.lit("head").alias("basis"))
    return whole.unionByName(by_head.join(by_shuffle(whole), [*keys, "name", "tracked"], "left_anti"))
