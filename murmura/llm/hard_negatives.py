"""Hard-negative mining by a multiway hyperplane tree over all vectors.

Every node of the tree has several split points; a row goes to the nearest one's subtree. For each pair of a split point
and a sibling's subtree the tree holds the smallest and largest distance between the point and the subtree's rows, taken
over all rows. A score window of a query is an annulus of distances around it, so a subtree is eliminated where no
distance that its ranges leave possible meets an annulus. Leaves that remain are scored exactly, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import discard, materialize

#: Split points of a node; rows that a leaf should hold; most leaves (the tree stays of this size, leaves then grow).
FANOUT, LEAF_ROWS, MOST_LEAVES = 16, 128, 256
#: About so many rows, drawn by a hash, give the split points. All rows are indexed and give the distance ranges.
SAMPLE = 8192
#: Rows and queries that meet in one call at most: a leaf's rows and the queries that visit it are dealt into blocks.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Scores are exact as doubles below this; beyond it nothing is eliminated and scores wrap as Spark's long sums do.
EXACT = 2.0**52
_ALL = (1 << 63) - 1


@dataclass
class Tree:
    """points: split points of each node. child: for each of them the node below, or -1 - leaf. low, high: distances from
    split point i to the rows below j. least, most: squared lengths of the rows below j."""

    width: int
    points: list[np.ndarray] = field(default_factory=list)
    child: list[np.ndarray] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    least: list[np.ndarray] = field(default_factory=list)
    most: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


def split_points(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` different rows of x: the one farthest from the mean, then always the one farthest from those chosen."""
    chosen = [int(distances(x, x.mean(0)[None]).argmax())]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < most and near.max() > 1e-3:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def grown_tree(sample: np.ndarray, leaves: int) -> Tree:
    """A tree over ``sample`` of about ``leaves`` leaves; nodes of equal rows stay leaves."""
    tree = Tree(sample.shape[1])
    enough = max(2.0, len(sample) / max(1, leaves))

    def grow(x: np.ndarray) -> int:
        if len(x) <= enough or len(points := split_points(x, int(min(FANOUT, max(2, round(len(x) / enough)))))) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.points)
        m = len(points)
        tree.points.append(points)
        tree.child.append(np.zeros(m, np.int64))
        for held, start in ((tree.low, np.inf), (tree.high, -np.inf)):
            held.append(np.full((m, m), start))
        for held, start in ((tree.least, np.inf), (tree.most, -np.inf)):
            held.append(np.full(m, start))
        nearest = distances(x, points).argmin(1)
        for j in range(m):
            tree.child[node][j] = grow(x[nearest == j])
        return node

    grow(sample)
    return tree


def descend(tree: Tree, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every node that rows of x reach: the node, their numbers, their distances to its points, the nearest point."""
    todo = [(0, np.arange(len(x)))] if tree.points else []
    while todo:
        node, rows = todo.pop()
        d = distances(x[rows], tree.points[node])
        nearest = d.argmin(1)
        yield node, rows, d, nearest
        for j in np.unique(nearest):
            if tree.child[node][j] >= 0:
                todo.append((int(tree.child[node][j]), rows[nearest == j]))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    for node, rows, _, nearest in descend(tree, x):
        below = tree.child[node][nearest]
        out[rows[below < 0]] = -1 - below[below < 0]
    return out


def surviving(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """queries x leaves: whether the leaf may hold a row whose score lies in one of the query's windows.

    low, high: queries x windows, NaN where a query has fewer windows."""
    out = np.zeros((len(x), max(1, tree.leaves)), bool)
    if not tree.points:
        out[:] = True
        return out
    length = (x * x).sum(1)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        d = distances(x[at], tree.points[node])
        # Distances of a query from the rows below j that every split point's range leaves possible.
        inner = np.maximum(d[:, :, None] - tree.high[node][None], tree.low[node][None] - d[:, :, None]).max(1).clip(0.0)
        outer = (d[:, :, None] + tree.high[node][None]).min(1)
        slack = 1e-6 * (length[at][:, None] + tree.most[node][None]) + 1.0
        with np.errstate(invalid="ignore"):
            best = (length[at][:, None] + tree.most[node][None] - inner**2) / 2 + slack
            worst = (length[at][:, None] + tree.least[node][None] - outer**2) / 2 - slack
        meets = ((low[at][:, None, :] <= best[:, :, None]) & (high[at][:, None, :] >= worst[:, :, None])).any(2)
        for j, below in enumerate(tree.child[node]):
            if not (kept := at[meets[:, j]]).size:
                continue
            if below < 0:
                out[kept, -1 - below] = True
            else:
                todo.append((int(below), kept))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


# -- index --------------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """rows: vec_id, label, q, place, leaf, block of every row; tree; blocks of each leaf; whether scores are exact doubles."""

    rows: DataFrame
    tree: Tree
    blocks: DataFrame
    exact: bool


def indexed(rows: DataFrame, *, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, row_block: int = ROW_BLOCK) -> Index:
    """The tree over all of ``rows`` (vec_id, label, q: array<bigint>).

    What reaches the driver: one row of counts, about ``sample`` vectors, and the distance ranges of the tree (at most
    MOST_LEAVES leaves and FANOUT split points a node), pre-aggregated by tasks."""
    spark = rows.sparkSession
    rows = materialize(rows.select("vec_id", "label", "q").withColumn("place", F.monotonically_increasing_id()), "vectors")
    size = F.array_max(F.transform("q", lambda v: F.abs(v)))
    n, width, top = rows.agg(F.count("*"), F.max(F.size("q")), F.max(size)).first()
    width, exact = width or 0, bool(width) and float(top or 0) ** 2 * width < EXACT
    share = min(1.0, sample / max(1, n))
    drawn = rows.where(F.xxhash64("place", "vec_id").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30))).select("q").toArrow()
    x = _matrix(drawn["q"], max(1, width))
    tree = grown_tree(x, min(MOST_LEAVES, n // leaf_rows)) if len(x) and exact else Tree(max(1, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("leaf", pa.array(leaf_of(tree, _matrix(b.column("q"), tree.width)), pa.int32()))

    placed = materialize(rows.mapInArrow(place, "vec_id long, label int, q array<bigint>, place long, leaf int"), "vectors-by-leaf")
    discard(rows)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.full((len(p) + 1, len(p)), np.inf), np.full((len(p) + 1, len(p)), -np.inf)) for p in tree.points]
        for b in batches:
            x = _matrix(b.column("q"), tree.width)
            square = (x * x).sum(1)
            for node, at, d, nearest in descend(tree, x):
                low, high = seen[node]
                both = np.column_stack([d, square[at]])
                for j in np.unique(nearest):
                    mine = both[nearest == j]
                    low[:, j] = np.minimum(low[:, j], mine.min(0))
                    high[:, j] = np.maximum(high[:, j], mine.max(0))
        for node, (low, high) in enumerate(seen):
            i, j = np.nonzero(high > -np.inf)
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), node), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(low[i, j]), pa.array(high[i, j])],
                    names=["node", "i", "j", "low", "high"],
                )

    if tree.points:
        found = placed.select("q").mapInArrow(ranges, "node int, i int, j int, low double, high double")
        for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            if r.i == len(tree.points[r.node]):
                tree.least[r.node][r.j], tree.most[r.node][r.j] = r.low, r.high
            else:
                tree.low[r.node][r.i, r.j], tree.high[r.node][r.i, r.j] = r.low - 1e-6 * (1 + r.low), r.high + 1e-6 * (1 + r.high)
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / row_block).cast("int").alias("blocks"))
    blocks = spark.createDataFrame(blocks.collect(), blocks.schema)  # a row a leaf
    block = F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")
    return Index(placed.join(F.broadcast(blocks), "leaf").withColumn("block", block), tree, blocks, exact)


# -- search -------------------------------------------------------------------------------------------------------------

_WINDOWS = "array<struct<w:int,low:bigint,high:bigint>>"
_HITS = "anchor long, w int, other long, other_id long, score long"


def visits(index: Index, routed: DataFrame, queries: DataFrame, *, same: bool, k: int, query_block: int) -> DataFrame:
    """anchor, w, other, other_id, score: the first k rows of each window among the rows of the leaf that a row of ``routed``
    (anchor, windows, leaves) visits, for each block of the leaf by itself; ``queries`` has anchor, label, q.

    Queries are joined to their vectors before they are dealt to leaves, so no side that Spark may broadcast has a row a visit."""
    spark = routed.sparkSession
    chunks = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / query_block).cast("int").alias("chunks"))
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)  # a row a leaf
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(queries, "anchor").withColumn("leaf", F.explode("leaves")).drop("leaves").join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.col("chunks")).cast("int"))
    left = left.join(F.broadcast(index.blocks), "leaf").withColumn("block", spread("blocks")).select("leaf", "block", "chunk", "anchor", "label", "q", "windows")
    right = index.rows.join(F.broadcast(chunks), "leaf").withColumn("chunk", spread("chunks")).select("leaf", "block", "chunk", "place", "vec_id", "label", "q")
    width, exact = index.tree.width, index.exact

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            q, x = _matrix(queries["q"], width), _matrix(rows["q"], width)
            if not exact:
                q, x = q.astype(np.int64), x.astype(np.int64)
            place, label = rows["place"].to_numpy(), rows["label"].to_numpy()
            missing = rows["vec_id"].is_null().to_numpy()
            ids = rows["vec_id"].fill_null(0).to_numpy()
            scores = (q @ x.T).astype(np.int64)
            for s, anchor, kind, windows in zip(scores, queries["anchor"].to_pylist(), queries["label"].to_pylist(), queries["windows"].to_pylist()):
                fit = (label == kind) & (place != anchor) if same else label != kind
                for w in windows:
                    at = np.flatnonzero(fit & (s >= w["low"]) & (s <= w["high"]))
                    if len(at) > k:
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((place[at], ids[at], missing[at], -s[at]))[:k]]
                    out += [(anchor, w["w"], int(place[i]), None if missing[i] else int(ids[i]), int(s[i])) for i in at]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "w", "other", "other_id", "score"])

    keys = ["leaf", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _HITS)


def first_k(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each anchor and window, with rank; Spark cuts each task's hits before the shuffle."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(index: Index, queries: DataFrame, *, same: bool, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The first k rows (of the anchor's label if ``same``, else of others) in each window of ``queries`` (anchor, label, q,
    leaf, windows).

    Each query visits its own leaf first. The k-th score found there narrows its windows; then it visits every other leaf
    whose distance ranges meet one of the narrowed annuli."""
    tree, exact = index.tree, index.exact
    vectors = queries.select("anchor", "label", "q")
    home = materialize(first_k(visits(index, queries.select("anchor", "windows", F.array("leaf").alias("leaves")), vectors, same=same, k=k, query_block=query_block), k), "home-hits")
    bound = home.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
    reached = F.coalesce(F.try_element_at("reached", F.col("at.w")), F.lit(-_ALL))
    narrowed = (
        queries.select("anchor", F.posexplode("windows").alias("i", "at")).join(bound, "anchor", "left")
        .select("anchor", F.struct(F.col("at.w").alias("w"), F.greatest("at.low", reached).alias("low"), F.col("at.high").alias("high")).alias("at"))
        .groupBy("anchor").agg(F.array_sort(F.collect_list("at")).alias("windows"))
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows = b.column("windows").to_pylist()
            most = max(map(len, windows), default=0)
            pad = lambda end: np.array([[float(w[end]) for w in ws] + [np.nan] * (most - len(ws)) for ws in windows]).reshape(len(windows), most)
            met = surviving(tree, _matrix(b.column("q"), tree.width), pad("low"), pad("high"))
            met[np.arange(len(met)), b.column("leaf").to_numpy()] = False
            leaves = pa.array([np.flatnonzero(m).astype(np.int32) for m in met], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("anchor"), b.column("windows"), leaves], names=["anchor", "windows", "leaves"])

    rest = queries.drop("windows").join(narrowed, "anchor").select("anchor", "q", "leaf", "windows")
    routes = materialize(rest.mapInArrow(route, f"anchor long, windows {_WINDOWS}, leaves array<int>"), "routes")
    away = visits(index, routes, vectors, same=same, k=k, query_block=query_block)
    return first_k(home.drop("rank").unionByName(away), k)


def mined_negatives(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **build: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label, q (array<bigint>); rows for which ``anchors``, a condition on these, holds are anchors. An anchor's positives are its
    first rows of the same label by score (integer inner product, ties by vec_id); for each of them the first rows of other
    labels whose score lies from ``low`` to ``high`` hundredths of the positive's come back, all if fewer.

    Rows with a null label or vector, or a null component, take no part. A null vec_id is no anchor where ``anchors`` is
    null for it, and stands after others of its score. Rows that share a vec_id, or repeat whole, count one by one, ties
    in the order of the table; shorter vectors end in zeros; an empty table gives no rows; other columns are left aside."""
    rows = rows.where("label IS NOT NULL AND q IS NOT NULL AND NOT exists(q, v -> v IS NULL)")
    index = indexed(rows.select("vec_id", F.col("label").cast("int").alias("label"), "q"), **build)
    query = index.rows.where(F.coalesce(anchors, F.lit(False)))
    query = materialize(query.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q", "leaf"), "anchors")
    whole = F.array(F.struct(F.lit(1).alias("w"), F.lit(-_ALL).alias("low"), F.lit(_ALL).alias("high")))
    near = searched(index, query.drop("anchor_id").withColumn("windows", whole), same=True, k=positives)
    near = near.select("anchor", F.col("rank").alias("w"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = materialize(near, "positives")
    share = lambda f, percent: f(F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)).cast("long")
    window = F.struct("w", share(F.ceil, low).alias("low"), share(F.floor, high).alias("high"))
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    far = searched(index, query.drop("anchor_id").join(windows, "anchor"), same=False, k=negatives)
    out = far.join(near, ["anchor", "w"]).join(query.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def floored(embedding: Column | str, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a double; null where a component is null, NaN or infinite."""
    fine = ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(fine, F.transform(embedding, lambda v: F.floor(v.cast("double") * factor)))
