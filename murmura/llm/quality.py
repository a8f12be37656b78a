"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Mergeable quantile sketches of each measure per language and source give fences that replace fixed cutoffs: first the
body of each group (median and outer deciles), which tells its sound documents, then the tail quantiles of those.
Documents are joined to the fences of their group and filtered.

A sketch counts values in bins of equal relative width, so sketches of tasks, sources and languages merge by adding
counts, in any order to the same result, and a quantile is true to one part in a thousand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize

# ASCII white space of the word rule, and the symbols of the symbol rule.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: measure -> (fence below, fence above, tells sound documents). Repetition is rare in any group, so that its deciles
#: are zero and tell nothing; symbols and word lengths have a body.
MEASURES = {
    "symbol_ratio": (False, True, True),
    "dup_line_ratio": (False, True, False),
    "repeat_ratio": (False, True, False),
    "mean_word_chars": (True, True, True),
}
#: Ratio of neighbouring bins, and the bin of zero.
GROWTH, ZERO = 1.002, -(2**30)
#: Documents in a group with fences of its own; thinner ones take those of their language, thin languages the corpus's.
LEAST_GROUP = 100
#: Standard deviations beyond a fence that reject a document.
SURE = 3.0


def with_word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with words), n_dup_lines and n_repeat_words of its ``text`` (null: none).

    Windows of five words are compared by XXH64 over their words. Only texts where a hash occurs twice sort their windows.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    n = F.size("q_words")
    hashed = F.transform("q_words", lambda w: F.xxhash64(w))
    window = F.expr(
        f"CASE WHEN size(q_hash) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, size(q_hash) - {WINDOW - 1}),"
        f" i -> xxhash64({', '.join(f'element_at(q_hash, i + {k})' for k in range(WINDOW))})) END"
    )
    # Positions of windows that equal a neighbour in sorted order, then the union of their words.
    sorted_windows = F.expr("array_sort(transform(q_win, (h, i) -> struct(h, i)))")
    pairs = F.expr("filter(zip_with(q_sorted, slice(q_sorted, 2, size(q_sorted)), (a, b) -> IF(a.h = b.h, array(a.i, b.i), NULL)), p -> p IS NOT NULL)")
    covered = F.expr(f"aggregate(zip_with(q_at, slice(q_at, 2, size(q_at)), (a, b) -> least(coalesce(b - a, {WINDOW}), {WINDOW})), 0L, (s, x) -> s + x)")
    got = docs.withColumns({"q_words": words, "q_lines": lines}).withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("q_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("q_lines").cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_hash": hashed,
        }
    )
    got = got.withColumn("q_win", window)
    got = got.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_win")) < F.size("q_win"), sorted_windows))
    got = got.withColumn("q_at", F.sort_array(F.array_distinct(F.flatten(pairs))))
    got = got.withColumn("n_repeat_words", F.when(F.col("q_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return got.drop("q_words", "q_lines", "q_hash", "q_win", "q_sorted", "q_at")


def base_failed() -> Column:
    """The fixed base rule: under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Measures that count something of a document: the count, what it is out of, and how many go by at once (a window that is
#: met twice repeats ten words).
COUNTS = {"symbol_ratio": ("n_symbols", "word_chars", 1), "dup_line_ratio": ("n_dup_lines", "n_lines", 1), "repeat_ratio": ("n_repeat_words", "n_words", 2 * WINDOW)}


def _measures() -> dict[str, Column]:
    size = lambda c: F.greatest(F.col(c), F.lit(1))
    return {k: F.col(n) / size(of) for k, (n, of, _) in COUNTS.items()} | {"mean_word_chars": F.col("word_chars") / size("n_words")}


def spreads(rows: DataFrame, counted: DataFrame, least_group: int) -> DataFrame:
    """s_lang, s_source and, for every group of ``counted``, what its documents differ by: the rate of each count and the deviation of
    word lengths; over ``rows`` of the group, else of its language, else of all.

    Both come from sums that tasks and groups add up. rate: the count out of its size, three more than were seen, so that a group
    without any is not taken to be sure. deviation: of a word's length, as documents' means show it over their numbers of words."""
    sums = [F.count("*").alias("n")]
    for k, (n, of, unit) in COUNTS.items():
        x, size = F.col(n) / unit, F.greatest(F.col(of), F.lit(1))
        sums += [F.sum(x).alias(f"x_{k}"), F.sum(size).cast("double").alias(f"o_{k}")]
    words = F.greatest(F.col("n_words"), F.lit(1))
    sums += [F.sum("word_chars").cast("double").alias("chars"), F.sum(words).cast("double").alias("words"), F.sum(F.col("word_chars") * F.col("word_chars") / words).alias("squares")]
    held = materialize(rows.groupBy("lang", "source").agg(*sums), "quality-sums")
    more = [F.sum(c).alias(c) for c in held.columns[2:]]
    stats = [((F.col(f"x_{k}") + 3) / F.col(f"o_{k}")).alias(f"rate_{k}") for k in COUNTS]
    stats.append(F.sqrt(F.greatest((F.col("squares") - F.col("chars") * F.col("chars") / F.col("words")) / F.col("n"), F.lit(0.0))).alias("deviation"))
    stat = F.struct("n", *stats)
    own, lang = held.select("lang", "source", stat.alias("s")).alias("b"), held.groupBy("lang").agg(*more).select("lang", stat.alias("s")).alias("l")
    top = held.agg(*more).select(stat.alias("s")).first()["s"]  # one row
    groups = counted.select("lang", "source").distinct().alias("g")
    same_lang, same_source = F.col("g.lang").eqNullSafe(F.col("b.lang")), F.col("g.source").eqNullSafe(F.col("b.source"))
    up = groups.join(own, same_lang & same_source, "left").join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
    own_n, lang_n = F.col("b.s.n") >= least_group, F.col("l.s.n") >= least_group
    pick = lambda c: F.when(own_n, F.col(f"b.s.{c}")).when(lang_n, F.col(f"l.s.{c}")).otherwise(F.lit(top[c]).cast("double")).alias(c)
    return up.select(F.col("g.lang").alias("s_lang"), F.col("g.source").alias("s_source"), *(pick(c) for c in [f"rate_{k}" for k in COUNTS] + ["deviation"]))


def _above(k: str, fence: Column, sure: float) -> Column:
    """Whether a document's count lies above what its group's fence, or at least its rate, lets one of its size have, by more than
    ``sure`` deviations on the scale on which counts of any mean vary alike (square roots)."""
    n, of, unit = COUNTS[k]
    x, size = F.col(n) / unit, F.greatest(F.col(of), F.lit(1))
    due = size * F.greatest(fence / unit, F.col(f"rate_{k}"))
    return F.sqrt(x) + F.sqrt(x + 1) - F.sqrt(4 * due + 1) > sure


def sketches(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """lang, source, measure, bin, n: the sketch of each measure and group. Tasks count before the shuffle, and the bins of a
    hot group are many keys."""
    bin_of = lambda c: F.when(c <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(c) / math.log(GROWTH)).cast("int"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bin_of(c).alias("bin")) for k, c in measures.items()))).alias("m")
    return rows.select("lang", "source", each).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], ranks: list[float], measures: list[str]) -> DataFrame:
    """keys, n and an array of the values at ``ranks`` for each measure; the bins of one sketch, some thousand at most, stand
    in a window."""
    part = Window.partitionBy(*keys, "measure")
    rows = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    rows = rows.withColumns({"upto": F.sum("n").over(part.orderBy("bin")), "total": F.sum("n").over(part)})
    at = lambda r: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(r * F.col("total") - 1e-9), F.lit(1)), F.col("bin")))
    value = lambda b: F.when(b == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), b) * (2 / (1 + GROWTH)))
    found = rows.groupBy(*keys, "measure").agg(F.max("total").alias("n"), F.array(*(value(at(r)) for r in ranks)).alias("q"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == k, F.col("q"))).alias(f"q_{k}") for k in measures))


def _by_group(rows: DataFrame, counted: DataFrame, measures: dict[str, Column], ranks: list[float], name: str, least_group: int) -> DataFrame:
    """f_lang, f_source and q_ (values at ``ranks``) of each measure over ``rows`` for every group of ``counted``: the
    group's own from ``least_group`` rows on, else its language's, else those of all rows; null without any row."""
    held = materialize(sketches(rows, measures), name)
    names = list(measures)
    own, lang = quantiles(held, ["lang", "source"], ranks, names).alias("b"), quantiles(held, ["lang"], ranks, names).alias("l")
    top = quantiles(held, [], ranks, names).first()  # one row
    groups = counted.select("lang", "source").distinct().alias("g")
    same_lang, same_source = F.col("g.lang").eqNullSafe(F.col("b.lang")), F.col("g.source").eqNullSafe(F.col("b.source"))
    up = groups.join(own, same_lang & same_source, "left").join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
    none = F.lit(None).cast("array<double>")

    def pick(k: str) -> Column:
        last = F.array(*map(F.lit, top[k])) if top[k] else none
        return F.when(F.col("b.n") >= least_group, F.col(f"b.{k}")).when(F.col("l.n") >= least_group, F.col(f"l.{k}")).otherwise(last)

    return up.select(F.col("g.lang").alias("f_lang"), F.col("g.source").alias("f_source"), *(pick(f"q_{k}").alias(f"q_{k}") for k in names))


def _joined(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with the limits of their language and source; the limits have one row a group."""
    return rows.join(limits, rows.lang.eqNullSafe(limits.f_lang) & rows.source.eqNullSafe(limits.f_source), "left")


def sound(counted: DataFrame, *, reach: float = 3.0, least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``counted`` that pass the base rule and stand within ``reach`` times the distance of the outer decile from their
    group's median in symbols and word length. Up to a tenth of bad documents moves neither. Where the deciles of a
    group are equal, documents with more than that are left out here; they are judged with the others."""
    body = {k: c for k, c in _measures().items() if MEASURES[k][2]}
    passed = counted.where(~base_failed())
    deciles = _by_group(passed, counted, body, [0.1, 0.5, 0.9], "quality-deciles", least_group)
    inside = F.lit(True)
    for k, c in body.items():
        q = F.col(f"q_{k}")
        near = 1e-9 + q[1] * (GROWTH - 1)  # a sketch's own error
        inside = inside & (c <= q[1] + reach * (q[2] - q[1]) + near) & (c >= q[1] - reach * (q[1] - q[0]) - near)
    return _joined(passed, deciles).where(inside).select(*counted.columns)


def fences(counted: DataFrame, *, reach: float = 3.0, tail: float = 0.01, least_group: int = LEAST_GROUP) -> DataFrame:
    """f_lang, f_source, low_ and high_ fences of each measure, and the spreads of the group (see `spreads`): the quantiles
    ``tail`` and 1 - ``tail`` of the group's sound documents (see `sound`), from mergeable sketches. Groups of under
    ``least_group`` sound documents take the fences of their language, thin languages those of the corpus; without any
    sound document there are none."""
    good = materialize(sound(counted, reach=reach, least_group=least_group), "quality-sound")
    found = _by_group(good, counted, _measures(), [tail, 1 - tail], "quality-tails", least_group)
    none = F.lit(None).cast("double")
    out = [(F.col(f"q_{k}")[i] if wanted else none).alias(f"{side}_{k}") for k, (low, high, _) in MEASURES.items() for i, side, wanted in ((0, "low", low), (1, "high", high))]
    limits, more = found.select("f_lang", "f_source", *out), spreads(good, counted, least_group)
    return limits.join(more, limits.f_lang.eqNullSafe(more.s_lang) & limits.f_source.eqNullSafe(more.s_source), "left").drop("s_lang", "s_source")


def failed_fences(sure: float) -> dict[str, Column]:
    """Whether a document lies outside the fences of its group by more than the group's spread, for each measure."""
    failed = {k: F.coalesce(_above(k, F.col(f"high_{k}"), sure), F.lit(False)) for k in COUNTS}
    noise = sure * F.col("deviation") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    c = _measures()["mean_word_chars"]
    failed["mean_word_chars"] = F.coalesce((c - noise > F.col("high_mean_word_chars")) | (c + noise < F.col("low_mean_word_chars")), F.lit(False))
    return failed


def judged(counted: DataFrame, limits: DataFrame, *, sure: float = SURE) -> DataFrame:
    """``counted`` with base_failed, failed (the measures whose fences a document fails) and kept: it passes the base rule and fails none."""
    failed = F.array_compact(F.array(*(F.when(c, k) for k, c in failed_fences(sure).items())))
    both = _joined(counted, limits).withColumns({"base_failed": base_failed(), "failed": failed})
    return both.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(*limits.columns)


def quality_verdicts(docs: DataFrame, *, reach: float = 3.0, tail: float = 0.01) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source).

    A null text has no words and fails the base rule, as an empty one does; texts of any length are read whole; null
    languages and sources are groups, a null doc_id stays null; a group without sound documents has the fences of its
    language; repeated rows are judged alike; an empty table gives no rows; other columns are left aside."""
    counted = materialize(with_word_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-counts")
    return judged(counted, materialize(fences(counted, reach=reach, tail=tail), "quality-fences"))


def keep_good(docs: DataFrame, *, reach: float = 3.0, tail: float = 0.01) -> DataFrame:
    """The rows of ``docs`` that `quality_verdicts` keeps, with all their columns as they are, whatever names they have.

    Texts are measured once, written beside their counts, and never shuffled."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "lang", "source")
    counted = materialize(with_word_counts(whole).drop("text"), "quality-rows")
    counts = counted.drop("row")
    verdicts = judged(counted, materialize(fences(counts, reach=reach, tail=tail), "quality-fences"))
    return verdicts.where("kept").select("row.*")
