"""Conversation repair by an auction shortest path over the lattice of turns.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its turns and the four states of that
pattern span a lattice; arcs keep, rerole, delete or insert a turn at integer costs. The auction algorithm extends and
contracts a path and raises node prices until every origin's path has reached the end; prices then are least costs, an
arc is tight where its cost makes up the price difference, and the cheapest edits that are least in ASCII are read off the
tight arcs from the first turn on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize

#: Characters that are white space, and those that end a whole text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
FAULTS = ("blank", "duplicate", "truncated")
#: States: nothing read, after s, after u, after a. The next state by initial; where an inserted or reroled turn leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, **{(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
TURNED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    """Keep is free, ties included no zero-cost cycle exists as inserting costs something."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1  # more for a truncated turn that stays


def role_steps(initial: str, fault: int, costs: Costs) -> list[list[tuple[str, int, int]]]:
    """For each state the arcs over one turn: edit, cost, next state. ``fault``: 0 or the number of the turn's fault."""
    out: list[list[tuple[str, int, int]]] = []
    more = costs.truncated if fault == 3 else 0
    for state in range(4):
        arcs = [("D", costs.delete, state)]
        if fault not in (1, 2):
            if (state, initial) in NEXT:
                arcs.append(("K", more, NEXT[state, initial]))
            arcs.append(("R", costs.rerole + more, TURNED[state]))
        out.append(arcs)
    return out


def repaired(turns: list[tuple[str, int]], costs: Costs = Costs()) -> tuple[int, str]:
    """Least cost and edits of a conversation given as (initial, fault) of its turns.

    Nodes (turn, state) are auctioned as origins from the last turn to the first, each from the prices that earlier
    origins left. A path starts at the origin; its end contracts (the price rises to the cheapest arc's cost plus the price
    behind it, and the path steps back) or extends over that arc, until it stands on a node whose own path to the end is known.
    A turn's four nodes begin at the least cost of leaving the turn, which is below all their final prices, so few steps are
    needed a node; prices never exceed what arcs allow, so each final price is the least cost from its node."""
    n = len(turns)
    known: dict[tuple[str, int], list] = {}
    steps = [known[t] if t in known else known.setdefault(t, role_steps(*t, costs)) for t in turns]
    price = [[0] * 4 for _ in range(n + 1)]
    settled = [[False] * 4 for _ in range(n + 1)]
    final = (START, ASSISTANT)

    def arcs(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """edit, cost, turn and state behind the arc, edits in ASCII order; the end is turn n + 1."""
        ahead = [(e, c, i + 1, q) for e, c, q in steps[i][state]] if i < n else [("", 0, n + 1, 0)] * (state in final)
        inserted = ("I", costs.insert, i, TURNED[state])
        return [ahead[0], inserted, *ahead[1:]] if i < n else [*ahead, inserted]

    def cost_behind(arc: tuple[str, int, int, int]) -> int:
        return arc[1] + (price[arc[2]][arc[3]] if arc[2] <= n else 0)

    for i in range(n, -1, -1):
        if i < n:
            price[i] = [min(c + price[i + 1][q] for arcs_of in steps[i] for _, c, q in arcs_of)] * 4
        for origin in range(4):
            path = [(i, origin)]
            while not settled[path[-1][0]][path[-1][1]]:
                at, state = path[-1]
                best = min(arcs(at, state), key=cost_behind)
                least = cost_behind(best)
                if price[at][state] < least:
                    price[at][state] = least
                    if len(path) > 1:
                        path.pop()
                elif best[2] > n:
                    break
                else:
                    path.append((best[2], best[3]))
            for at, state in path:
                settled[at][state] = True
    edits: list[str] = []
    i, state = 0, START
    while i <= n:
        edit, _, i, state = next(a for a in arcs(i, state) if cost_behind(a) == price[i][state])
        edits.append(edit)
    return price[0][START], "".join(edits)


# -- turns --------------------------------------------------------------------------------------------------------------


def with_faults(turns: DataFrame, group: str = "conv_id") -> DataFrame:
    """``group``, pos (from 1), turn, role, text, initial, fault (0, or 1 blank, 2 duplicate, 3 truncated) of every row.

    Rows of a conversation stand by turn (nulls first), role, text. The second window needs no second shuffle."""
    order = Window.partitionBy(group).orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.select(group, "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"pos": F.row_number().over(order), "said": F.sha2(F.encode("text", "UTF-8"), 256)})
    copy = F.row_number().over(Window.partitionBy(group, "role", "said").orderBy("pos"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(F.length(bare) == 0, 1).when(copy > 1, 2).when(~F.right(bare, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    return rows.select(group, "pos", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def by_group(table: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows of a group in one partition and in order; Spark sorts with spills, tasks read a batch at a time."""
    return table.repartition(group).sortWithinPartitions(group, *order)


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(group, rows) of a sorted stream; a group's rows are read as they are asked for, and to their end before the next."""
    stream = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns)))
    row = next(stream, None)
    while row is not None:
        key = row[0]

        def mine() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(stream, None)

        rows = mine()
        yield key, rows
        for _ in rows:
            pass


def audits(rows: DataFrame, group: str = "conv_id", *, costs: Costs = Costs()) -> DataFrame:
    """``group``, gaps, blank, duplicate, truncated, illegal, cost, audit of each group of ``with_faults`` rows.

    Only positions, turns, initials and faults come here: what a task holds of a conversation is a few integers a turn."""
    kinds = [(group, rows.schema[group].dataType.simpleString()), *((c, "long") for c in ("gaps", *FAULTS, "illegal", "cost")), ("audit", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([(group, b.schema.field(group).type), *((c, pa.string() if c == "audit" else pa.int64()) for c, _ in kinds[1:])])
                yield b

        for key, turns_of in _groups(watched(), [group, "turn", "initial", "fault"]):
            turns, faults, illegal = [], [0] * 4, 0
            first = last = before = None
            distinct = 0
            for turn, initial, fault in turns_of:
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                faults[fault] += 1
                turns.append((initial, fault))
            cost, audit = repaired(turns, costs)
            gaps = last - first + 1 - distinct if distinct else 0
            out.append({group: key, "gaps": gaps, **dict(zip(FAULTS, faults[1:])), "illegal": illegal, "cost": cost, "audit": audit})
            if len(out) >= 2000:
                yield flushed()
                out.clear()
        if out:
            yield flushed()

    light = by_group(rows.select(group, "pos", "turn", "initial", "fault"), group, "pos")
    return light.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds))


def edited(rows: DataFrame, found: DataFrame, group: str = "conv_id") -> DataFrame:
    """``group``, place (from 0), role, text of the repaired conversations: ``found`` has the audit of each.

    A conversation's audit comes ahead of its rows in one sorted stream, so texts pass through and are not held."""
    return _with_audit(rows, found, group).mapInArrow(_edited(group), f"`{group}` {rows.schema[group].dataType.simpleString()}, place long, role string, text string")


def digests(rows: DataFrame, found: DataFrame, group: str = "conv_id") -> DataFrame:
    """``group``, repaired_sha256: of the repaired turns as ``role:text``, joined by newlines, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, digest, kind, out = None, -1, None, None, []

        def flushed() -> pa.RecordBatch:
            keys, hashes = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(hashes)], names=[group, "repaired_sha256"])

        for b in _edited(group, ends=True)(batches):
            kind = b.schema.field(group).type
            for key, place, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if place < 0:  # the head of a conversation, also of one without turns
                    if digest is not None:
                        out.append((held, digest.hexdigest()))
                    held, digest = key, hashlib.sha256()
                    continue
                digest.update(f"\n{role}:{text}".encode() if place else f"{role}:{text}".encode())
            if len(out) >= 2000:
                yield flushed()
                out.clear()
        if digest is not None:
            out.append((held, digest.hexdigest()))
            yield flushed()

    kinds = f"`{group}` {rows.schema[group].dataType.simpleString()}, repaired_sha256 string"
    return _with_audit(rows, found, group).mapInArrow(run, kinds)


def _with_audit(rows: DataFrame, found: DataFrame, group: str) -> DataFrame:
    heads = found.select(group, F.lit(0).alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    return by_group(rows.select(group, "pos", "role", "text").unionByName(heads), group, "pos")


def _edited(group: str, *, ends: bool = False):
    """mapInArrow function over sorted rows; ``ends``: each conversation also gives a row of place -1 ahead of its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, k, state, place, out, size = "", 0, START, 0, [], 0

        def inserted(key: object) -> Iterator[tuple]:
            nonlocal k, state, place
            while k < len(audit) and audit[k] == "I":
                k, state = k + 1, TURNED[state]
                yield key, place, NAMES[state], ""
                place += 1

        for b in batches:
            kind = b.schema.field(group).type
            for key, pos, role, text in zip(*(b.column(c).to_pylist() for c in (group, "pos", "role", "text"))):
                if pos == 0:
                    audit, k, state, place = text, 0, START, 0
                    if ends:
                        out.append((key, -1, "", ""))
                else:
                    edit, k = audit[k], k + 1
                    if edit != "D":
                        state = NEXT[state, role[:1]] if edit == "K" else TURNED[state]
                        out.append((key, place, role if edit == "K" else NAMES[state], text))
                        size += len(text)
                        place += 1
                out += inserted(key)
                if size > 4_000_000 or len(out) >= 10_000:
                    yield _batch(out, kind, group)
                    out, size = [], 0
        if out:
            yield _batch(out, kind, group)

    return run


def _batch(rows: list[tuple], kind: pa.DataType, group: str) -> pa.RecordBatch:
    keys, places, roles, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=[group, "place", "role", "text"])


def damaged(turns: DataFrame) -> DataFrame:
    """Planted damage by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its ends, 3 repeats it, 4 makes
    it the user's. Nulls read as one space, but a null turn stays null as an order."""
    text_of: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    draw = F.crc32(F.concat(text_of["conv_id"], F.lit(":"), text_of["turn"]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of["role"].alias("role"), text_of["text"].alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(turns: DataFrame, originals: DataFrame, *, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of ``originals``.

    ``turns`` (conv_id, turn, role, text) are the rows to repair. A null role or text is one space; rows of a null conv_id
    are one conversation; turns may be null, tie or repeat: rows stand by turn (nulls first), role, text, and a repeat is a
    duplicate. Roles count by their first character, an empty one fits nowhere; texts of any length pass whole; a conversation without
    rows has zeros, an empty audit and the empty string's hash; other columns are left aside. What one task holds of a conversation is a
    few integers a turn, as its audit is one string; texts stream."""
    rows = materialize(with_faults(turns), "faults")
    found = materialize(audits(rows, costs=costs), "audits")
    out = found.join(digests(rows, found).withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same"))).drop("same")
    ids = originals.select(F.col("conv_id").alias("same")).distinct()
    none = hashlib.sha256().hexdigest()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    out = ids.join(out, F.col("conv_id").eqNullSafe(F.col("same")), "left")
    return out.select(F.col("same").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
