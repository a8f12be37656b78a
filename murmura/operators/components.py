"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.scratch import by_shuffle, discard, materialize

#: A node with more than this share of all rows is a hub; there are fewer than its inverse of them.
HUB_SHARE = 1 / 2048


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, heavy: float | None) -> DataFrame:
    """``rows`` joined by ``key`` to ``table``, one row a key with n, the number of rows of the key, which stays out.

    Hubs, keys of more than ``heavy`` rows, are so few that their part of the table is broadcast; the rows of other keys
    meet theirs by a shuffle in which no key is heavy. None: there are no hubs."""
    if heavy is None:
        return rows.join(by_shuffle(table.drop("n")), key)
    hubs = table.where(F.col("n") > heavy).drop("n").withColumn("_hub", F.lit(True))
    marked = rows.join(F.broadcast(hubs.select(key, "_hub")), key, "left")
    top = marked.where("_hub").drop("_hub").join(F.broadcast(hubs.drop("_hub")), key)
    rest = marked.where("_hub IS NULL").drop("_hub").join(by_shuffle(table.where(F.col("n") <= heavy).drop("n")), key)
    return top.unionByName(rest)


def heavy_rows(total: int) -> float | None:
    """Rows from which a key is a hub, at least 1,000; None where no key can have so many."""
    heavy = max(1000.0, total * HUB_SHARE)
    return heavy if total > heavy else None


#: Nodes that a task holds at once when it joins links by itself.
LOCAL_NODES = 500_000


def local_stars(edges: DataFrame, near: str) -> DataFrame:
    """``edges`` (a, b) as fewer ones that join the same nodes: links that share ``near`` come together, as far as partitions of
    even size allow, and each task puts what it joins in stars around the smallest node."""
    kind = edges.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        types: list = []

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(top(x), x) for x in parent]
            plain = lambda i: [dict(zip((f.name for f in types[0]), p[i])) if pa.types.is_struct(types[0]) else p[i] for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array(plain(0), types[0]), pa.array(plain(1), types[0])], names=["a", "b"])

        for batch in batches:
            types[:] = [batch.column("a").type]
            sides = [[tuple(x.values()) for x in c.to_pylist()] if pa.types.is_struct(types[0]) else c.to_pylist() for c in (batch.column("a"), batch.column("b"))]
            for a, b in zip(*sides):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > LOCAL_NODES:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    fields = f"a {kind.simpleString()}, b {kind.simpleString()}"
    return edges.hint("rebalance", near).select("a", "b").mapInArrow(run, fields)


def components(edges: DataFrame, near: str | None = None) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the undirected ``edges`` (a, b).

    ``near`` names a column of the links (its links mostly join each other) over which tasks join links by themselves first;
    nodes have no nulls then.

    Large-star and small-star steps in turn; what each leaves is written to the shared folder, so that no plan holds more than
    one of them, and the table before goes. The loop ends when all edges are stars around their smallest nodes. Minima are taken
    before the shuffle, and where there are hubs their edges stay spread over all tasks. Only nodes with an edge to another node
    come back."""
    if near is not None:
        edges = local_stars(edges, near)
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        total, loose, most = _shape(edges)
        if not loose:
            break
        heavy = heavy_rows(2 * total)
        if heavy is not None and most <= heavy:
            heavy = None  # no hubs; a large-star step gives no node more edges to smaller ones than it had
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        star = joined_by_key(both.where("v > u"), low, "u", heavy).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        before, star = edges, materialize(star, "stars")
        low = star.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = joined_by_key(star, low, "b", heavy).select("m", F.explode(F.array("a", "b")).alias("b"))
        edges = materialize(small.where("m <> b").select(F.col("m").alias("a"), "b").distinct(), "links")
        discard(before)
        discard(star)
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def _shape(edges: DataFrame) -> tuple[int, int, int]:
    """Of edges (a < b): their number, the number of nodes that are the upper end of one edge and have another edge too (none:
    all edges are stars around their smallest nodes), and the most edges that a node has."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    none = F.lit(0).cast("long")
    return tuple(nodes.agg(F.coalesce(F.sum("up"), none), F.count_if((F.col("up") > 0) & (F.col("n") > 1)), F.coalesce(F.max("n"), none)).first())
