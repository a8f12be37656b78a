"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into partitions, correlated bits together. If two fingerprints differ in at most
``tau`` bits and the partition thresholds t_1..t_m sum to tau - m + 1, then some partition differs in at most its t_i
bits. Thresholds (-1: not probed) are dealt by dynamic programming on estimated candidate counts; partitions are
probed by hash, candidates verified, and links joined into components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.components import components, heavy_rows, joined_by_key
from murmura.scratch import materialize

BITS = 64
#: A bucket of more rows is dealt out as pairs of blocks of this size.
BLOCK = 8192
#: Cost of one probe row, in verified candidates: a shuffled row against a few numpy operations.
ROW_COST = 400.0


# -- fingerprints -------------------------------------------------------------------------------------------------------


def shingle_bytes(text: str, width: int) -> list[bytes]:
    """Space-joined shingles of the words of a text, A-Z lower-cased; fewer words give the whole sequence."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :])]


def simhash(text: str, width: int, seed: int = 42) -> int:
    """Bits set in over half of the shingles' XXH64 values, repeats counted; 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingle_bytes(text, width)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 4096):
        part = h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t or "", width) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# -- partitions and thresholds --------------------------------------------------------------------------------------------


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and their 64 x 64 co-occurrence counts, summed over all rows; 4,096 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            raw = np.asarray(b.column("fp"), np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1).astype(np.float32)
            n += len(x)
            both += x.T @ x
        values = np.concatenate([[n], both.ravel()]).astype(np.int64)
        cols = [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)]
        yield pa.RecordBatch.from_arrays(cols, names=["cell", "n"])

    cells = nodes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(1 + BITS * BITS)
    for r in cells.collect():
        flat[r.cell] = r.n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal width; each group takes the free bit that correlates most with the bits it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < width:
            own.append(max(sorted(free), key=lambda b: corr[b, own].sum()))
            free.discard(own[-1])
        groups.append(sorted(own))
    return groups


def _within(p: np.ndarray, most: int) -> list[float]:
    """P(two fingerprints differ in at most t of these bits), t = 0..most, by the bits' own frequencies."""
    dist = np.zeros(len(p) + 1)
    dist[0] = 1.0
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return [float(min(1.0, dist[: t + 1].sum())) for t in range(most + 1)]


def thresholds(n: int, p: np.ndarray, groups: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum tau - m + 1, by dynamic programming over partitions; the cost counts probe rows
    and estimated candidates."""
    m = len(groups)
    total = tau - m + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        chance = _within(p[bits], tau)
        options = {-1: 0.0}
        probes, ways = 0.0, 1.0
        for t in range(min(tau, len(bits)) + 1):
            probes += ways  # all ways to flip t bits; half of them are needed, and one for itself
            ways *= (len(bits) - t) / (t + 1)
            options[t] = n * (1 + probes / 2) * ROW_COST + n * n / 2 * chance[t]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                k = used + t
                if k not in step or cost + c < step[k][0]:
                    step[k] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def probe_plan(nodes: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """Partitions (bit positions from the highest) with their thresholds; the cheapest number of partitions wins."""
    n, both = bit_statistics(nodes)
    p = np.diag(both) / max(n, 1)
    plans = []
    for m in range(2, tau + 2):
        groups = grouped_bits(n, both, m)
        cost, ts = thresholds(n, p, groups, tau)
        plans.append((cost, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


# -- probing and verifying ------------------------------------------------------------------------------------------------


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """One row for each fingerprint, partition and probed key: part, key, fp, own (false: the key is a variant).

    A pair that differs in k <= t bits of a partition meets at a key that clears bits only: each side clears those it
    has set, so variants clear up to t bits, and both sides meet where all k differing bits are cleared."""
    masks = []
    for bits, t in plan:
        place = [np.uint64(1 << (BITS - 1 - b)) for b in bits]
        keep = np.uint64(sum(map(int, place)))
        clear = [np.uint64(sum(map(int, c))) for k in range(t + 1) for c in itertools.combinations(place, k)]
        masks.append((keep, np.asarray(clear, np.uint64)))
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                fp = np.asarray(b.column("fp"), np.int64)[k : k + 2000].view(np.uint64)
                for part, (keep, clear) in enumerate(masks):
                    i, c = np.nonzero((fp[:, None] & clear[None, :]) == clear[None, :])
                    key = (fp[i] & keep) & ~clear[c]
                    cols = [np.full(len(i), part, np.int32), key.view(np.int64), fp[i].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=schema)

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long")


def _forest(a: np.ndarray, tau: int, split: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all fingerprints of a bucket within tau bits of one another: every group that links join
    stays joined, by at most one link for each member. ``split``: links are sought between a[:split] and a[split:]."""
    if split is None and len(a) <= 1024:
        i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= tau, 1))
        if len(i) <= 2 * len(a):
            return [(a[i], a[j])]
    found = []
    side = np.zeros(len(a), bool) if split is None else np.arange(len(a)) < split
    todo = np.arange(len(a))
    front: list[int] = []
    while len(todo):
        if front:
            at = front.pop()
        else:
            at, todo = int(todo[0]), todo[1:]
        near = np.bitwise_count(a[todo] ^ a[at]) <= tau
        if split is not None:
            near &= side[todo] != side[at]
        hit = todo[near]
        if len(hit):
            todo = todo[~near]
            front += hit.tolist()
            found.append((np.full(len(hit), a[at]), a[hit]))
    return found


def _links(sorted_rows: DataFrame, tau: int) -> DataFrame:
    """Verified links of rows (part, key, pair, side, fp) that are sorted by bucket within their partition."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(fp: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if side[-1] == 0:  # a bucket, or a block against itself
            a = np.unique(fp)
            return _forest(a, tau, None) if len(a) > 1 else []
        x, y = np.unique(fp[side == 1]), np.unique(fp[side == 2])
        return _forest(np.concatenate([x, y]), tau, len(x)) if len(x) and len(y) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def table(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64),) * 2
            lo, hi = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
            both = np.unique(np.stack([lo, hi], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

        def groups(cols: list[np.ndarray], last: bool) -> tuple[list, list[np.ndarray] | None]:
            part, key, pair, side, fp = cols
            new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            edges = np.concatenate([[0], new, [len(fp)]])
            n = len(edges) - 1 if last else len(edges) - 2
            size = np.diff(edges[: n + 1])
            u, found = fp.view(np.uint64), []
            small = (size > 1) & (size <= 16)
            small &= side[edges[:n]] == 0 if n else small
            for d in range(1, 16):  # small buckets at once: each row against the one d places on
                at = edges[:n][small & (size > d)]
                left = size[small & (size > d)] - d
                if not len(at):
                    break
                i = np.repeat(at - (np.cumsum(left) - left), left) + np.arange(left.sum())
                ok = (np.bitwise_count(u[i] ^ u[i + d]) <= tau) & (u[i] != u[i + d])
                found.append((u[i][ok], u[i + d][ok]))
            for g in np.flatnonzero((size > 1) & ~small):
                found += solve(u[edges[g] : edges[g + 1]], side[edges[g] : edges[g + 1]])
            return found, None if last else [c[edges[n] :] for c in cols]

        for b in batches:
            cols = [np.asarray(b.column(c)) for c in ("part", "key", "pair", "side", "fp")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if len(cols[0]):
                found, rest = groups(cols, False)
                yield table(found)
        if rest is not None:
            yield table(groups(rest, True)[0])

    return sorted_rows.mapInArrow(run, "a long, b long")


def bucket_links(rows: DataFrame, tau: int, *, block: int = BLOCK) -> DataFrame:
    """Links (a < b, fingerprints) that join every two fingerprints of one bucket that chains of at most ``tau`` differing
    bits join within it; ``rows`` are (part, key, fp). Buckets above ``block`` rows go as pairs of blocks to several tasks;
    no bucket is cut or sampled."""
    spark = rows.sparkSession
    sizes = rows.groupBy("part", "key").count().where(F.col("count") > block)
    large = materialize(sizes, "simhash-large").select("part", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    if large.isEmpty():
        dealt = rows.select("part", "key", F.lit(0).alias("pair"), F.lit(0).alias("side"), "fp")
    else:
        # At most rows / block buckets are large; Spark broadcasts them only below its size threshold.
        rows = rows.join(large, ["part", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
        other = F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")).alias("other")
        dealt = rows.select("part", "key", "blocks", "own", "fp", other).selectExpr(
            "part", "key", "cast(least(own, other) * coalesce(blocks, 1) + greatest(own, other) AS int) AS pair",
            "CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END AS side", "fp",
        )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "part", "key", "pair").sortWithinPartitions("part", "key", "pair", "side", "fp")
    return _links(dealt, tau).distinct()


def links(nodes: DataFrame, tau: int, *, block: int = BLOCK) -> DataFrame:
    """Links (a < b, fingerprints) that join every two of the distinct ``fp`` that chains of at most ``tau`` differing
    bits join."""
    return bucket_links(probes(nodes, probe_plan(nodes, tau)), tau, block=block)


# -- groups -------------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, *, width: int = 3, tau: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``tau`` bits) of every row.

    Texts without words have fingerprint zero and link like any other; a null text has no words; texts of any length are
    read whole; equal rows come back as often as they stand; a row with a null doc_id gets the component of its fingerprint;
    an empty table gives no rows; other columns are left aside."""
    fps = materialize(fingerprints(docs, width=width), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    roots = components(links(nodes, tau)).withColumnsRenamed({"node": "fp"})
    classed = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    ids = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classed.select("fp", "root", "n").join(ids, "root").select("fp", "component_id", "n")
    return joined_by_key(fps, classes, "fp", heavy_rows(fps.count())).select("doc_id", "fp", "component_id")


# -- texts of similar shingles --------------------------------------------------------------------------------------------

#: Shingles that a partial fingerprint covers on average, and partial fingerprints at each level.
PART_SHINGLES, PARTS = 6, 16
#: Texts that share a partial fingerprint are candidates if their whole ones differ in at most this many bits. At similarity
#: 0.8 about 10 of 64 bits differ, between unlike texts 32, so chance meetings in a class end here.
LOOSE = 22


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in set(shingle_bytes(text, width))), np.uint64))


def part_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the SimHash fingerprints of shingle classes (hash modulo 2^level) at the two levels where a class holds
    a few shingles, and at the next finer one while the second has under PARTS classes: a pair whose sizes round apart
    shares two levels there. Texts at similarity 0.8 share a level, and with a chance above 0.95 a whole class."""
    if not len(h):
        return np.zeros(0, np.int64)
    first = max(0, round(float(np.log2(len(h) / PART_SHINGLES))))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    out = []
    for level in range(first, first + (3 if 2 << first < PARTS else 2)):
        c = (h & np.uint64((1 << level) - 1)).astype(np.int64)
        at = np.flatnonzero(c < PARTS)
        at = at[np.argsort(c[at], kind="stable")]
        if not len(at):
            continue
        own, start, n = np.unique(c[at], return_index=True, return_counts=True)
        sums = np.add.reduceat(bits[at], start, axis=0)
        raw = np.packbits(2 * sums > n[:, None], axis=1)
        out += [xxhash.xxh64_intdigest(r.tobytes() + bytes([level, k])) for r, k in zip(raw, own.tolist())]
    return np.asarray(out, np.uint64).view(np.int64)


def _similar(sets: list[np.ndarray], at_least: float, split: int | None) -> list[tuple[int, int]]:
    """Links that join all sets whose chains of Jaccard similarity ``at_least`` join them (see _forest)."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    side = np.zeros(len(sets), bool) if split is None else np.arange(len(sets)) < split

    def postings(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([sets[i] for i in left])
        doc = np.repeat(left, n[left])
        order = np.argsort(flat, kind="stable")
        return flat[order], doc[order]

    free = np.ones(len(sets), bool)
    term, doc = postings(np.arange(len(sets)))
    built = len(sets)
    found: list[tuple[int, int]] = []
    for seed in np.argsort(-n, kind="stable").tolist():
        if not free[seed]:
            continue
        free[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            left = np.flatnonzero(free)
            if not len(left):
                return found
            if 2 * len(left) < built:
                (term, doc), built = postings(left), len(left)
            lo, hi = np.searchsorted(term, sets[at]), np.searchsorted(term, sets[at], "right")
            size = hi - lo
            total = int(size.sum())
            if not total:
                continue
            hits = doc[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(total)]
            shared = np.bincount(hits, minlength=len(sets))
            ok = free & (shared >= at_least * (n + n[at] - shared) - 1e-9) & (shared > 0)
            if split is not None:
                ok &= side != side[at]
            new = np.flatnonzero(ok).tolist()
            for i in new:
                free[i] = False
            front += new
            found += [(at, i) for i in new]
    return found


def similar_texts(docs: DataFrame, *, width: int = 5, at_least: float = 0.8, tau: int = 3, block: int = 2048) -> DataFrame:
    """doc_id and component_id (smallest doc_id of the group, null if it has none) of every row, in groups of
    ``text_groups``. Groups that hold one doc_id with different texts can have the same component_id."""
    rows, groups = _hashed(docs), text_groups(docs, width=width, at_least=at_least, tau=tau, block=block)
    first = groups.where("node = root").select("root", F.col("least").alias("component_id"))
    copies = rows.select("doc_id", "same")
    table = groups.join(first, "root").select("same", "component_id").join(copies.groupBy("same").agg(F.count("*").alias("n")), "same")
    return joined_by_key(copies, table, "same", heavy_rows(copies.count())).select("doc_id", "component_id")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and same, the hash that stands for the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("same"))


def text_groups(docs: DataFrame, *, width: int = 5, at_least: float = 0.8, tau: int = 3, block: int = 2048) -> DataFrame:
    """same (hash of the text), node, root and least (smallest doc_id with the text, null: none) of every distinct text:
    texts of one root are joined by sets of ``width``-word shingles whose Jaccard similarity is ``at_least``.

    Candidates are texts whose whole fingerprints differ in at most ``tau`` bits, or that share a partial fingerprint and
    differ in at most LOOSE bits of the whole ones; each is checked before candidates join into groups, and groups are
    verified on their whole shingle sets. Texts without words are alike only if equal, null is the empty text, an empty
    table gives no rows, texts of any length are read whole. Only texts join groups, whatever doc_ids they have; nodes are
    numbered by ``least``, nulls last, so the root of a group is its text with the smallest doc_id."""
    rows = _hashed(docs)
    out = pa.schema([("doc_id", pa.int64()), ("same", pa.string()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for k in range(0, len(texts), 1000):
                part = texts[k : k + 1000]
                sets = [shingle_hashes(t, width) for t in part]
                cols = [
                    b.column("doc_id").slice(k, len(part)),
                    b.column("same").slice(k, len(part)),
                    pa.array(np.fromiter((simhash(t, width) for t in part), np.uint64, len(part)).view(np.int64)),
                    pa.array([part_keys(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    signed = materialize(rows.mapInArrow(sign, "doc_id long, same string, fp long, keys array<long>"), "text-signatures")
    # Equal texts are one node.
    texts = signed.groupBy("same").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    order = [F.asc_nulls_last("least"), F.asc("same")]
    texts = materialize(texts, "distinct-texts").repartitionByRange(*order).sortWithinPartitions(*order)
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "text-numbers")
    wordy = texts.where(F.size("keys") > 0)
    prints = materialize(wordy.select("fp").distinct(), "text-prints")
    classes = wordy.select(F.lit(0).alias("part"), F.explode("keys").alias("key"), "fp").distinct()
    found = materialize(bucket_links(classes, LOOSE).union(links(prints, tau)).distinct(), "candidate-links")
    roots = components(found).toDF("fp", "root").distinct()
    groups = wordy.join(roots, "fp", "left").select("node", "same", "least", F.coalesce("root", "fp").alias("group"))
    near = components(_verified(rows, materialize(groups, "candidate-groups"), width, at_least, block)).distinct()
    return texts.select("same", "node", "least").join(near, "node", "left").select("same", "node", F.coalesce("root", "node").alias("root"), "least")


def _shingle_sets(rows: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """``groups`` with set, the shingles of each node's text. A text is read from a row with its smallest doc_id, so copies
    under other ids don't move."""
    on = (F.col("same") == F.col("node_same")) & F.col("doc_id").eqNullSafe(F.col("least"))
    names = [c for c in groups.columns if c not in ("same", "least")]
    texts = rows.join(groups.withColumnRenamed("same", "node_same"), on).select(*names, "text").dropDuplicates(["node"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(t, width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "set"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(shingled, ", ".join([*(f"{c} {kinds[c]}" for c in names), "set binary"]))


def _verified(rows: DataFrame, groups: DataFrame, width: int, at_least: float, block: int) -> DataFrame:
    """Links (a, b) of nodes within candidate groups (node, same, least, group).

    A group of up to ``block`` texts is compared in one task. In larger ones every text first meets the group's leader, the
    text of the smallest number, which goes to each block: texts like it are one part of the group and need no comparing
    among themselves. What is left meets both that part and itself, block by block, so all links between parts are found."""
    sized = groups.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    heavy = heavy_rows(groups.count())
    with_size = joined_by_key(groups, sized.withColumn("size", F.col("n")), "group", heavy).withColumnRenamed("size", "n")
    held = materialize(_shingle_sets(rows, with_size, width), "candidate-sets")
    keys = ["group", "pair", "side", "node", "set"]
    small = held.where(F.col("n") <= block).select("group", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "node", "set")
    large = held.where(F.col("n") > block)
    if large.isEmpty():
        return _compared(small, at_least)
    blocks = F.ceil(F.col("n") / block)
    members = large.where("node <> leader").select("group", F.pmod(F.xxhash64("node"), blocks).alias("pair"), F.lit(1).alias("side"), "node", "set")
    leaders = large.where("node = leader").select("group", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("pair"), F.lit(0).alias("side"), "node", "set")
    led = materialize(_led(leaders.unionByName(members), at_least), "led-links")
    part = large.join(led.select(F.col("b").alias("node"), F.lit(True).alias("led")), "node", "left").withColumn("led", F.coalesce("led", F.col("node") == F.col("leader")))
    counts = part.groupBy("group").agg(F.ceil(F.count_if("led") / block).alias("led_blocks"), F.ceil(F.count_if(~F.col("led")) / block).alias("free_blocks"), F.count("*").alias("n"))
    dealt = joined_by_key(part.drop("n"), counts.where("free_blocks > 0"), "group", heavy).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("led"), F.col("led_blocks")).otherwise(F.col("free_blocks"))))
    dealt = materialize(dealt.select("group", "node", "set", "led", "own", "led_blocks", "free_blocks"), "candidate-blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("free_blocks") - 1)).alias("other")
    # Blocks of the rest against one another (pairs from 0 on) and against blocks of the leader's part (below 0).
    among = dealt.where("NOT led").select("*", other).selectExpr(
        "group", "least(own, other) * free_blocks + greatest(own, other) AS pair", "CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END AS side", "node", "set")
    first = dealt.where("led").select("*", other).selectExpr("group", "-1 - (own * free_blocks + other) AS pair", "1 AS side", "node", "set")
    across = F.explode(F.sequence(F.lit(0).cast("long"), F.col("led_blocks") - 1)).alias("other")
    second = dealt.where("NOT led").select("*", across).selectExpr("group", "-1 - (other * free_blocks + own) AS pair", "2 AS side", "node", "set")
    rest = among.select(*keys).unionByName(first.select(*keys)).unionByName(second.select(*keys))
    return led.unionByName(_compared(small.unionByName(rest), at_least))


def _dealt(pairs: DataFrame) -> DataFrame:
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "group", "pair").sortWithinPartitions("group", "pair", "side", "node")


def _led(pairs: DataFrame, at_least: float) -> DataFrame:
    """Links (a, b) of each leader (side 0) with the members (side 1) of its block that are like it. A task holds one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader, own = None, None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for group, pair, side, node, raw in zip(*(b.column(c).to_pylist() for c in ("group", "pair", "side", "node", "set"))):
                x = np.frombuffer(raw, np.uint64)
                if side == 0:
                    now, leader, own = (group, pair), node, x
                elif now == (group, pair):
                    shared = len(np.intersect1d(own, x, assume_unique=True))
                    if shared and shared >= at_least * (len(own) + len(x) - shared) - 1e-9:
                        found.append((leader, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _dealt(pairs).mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, at_least: float) -> DataFrame:
    """Links (a, b) within each block of ``pairs`` (group, pair, side, node, set): of all texts (side 0), or between sides 1
    and 2."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solved() -> pa.RecordBatch:
            ids = [x[1] for x in held]
            split = None if held[-1][0] == 0 else sum(x[0] == 1 for x in held)
            got = _similar([np.frombuffer(x[2], np.uint64) for x in held], at_least, split) if len(held) > 1 and split != 0 and split != len(held) else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in got], pa.int64()), pa.array([ids[j] for _, j in got], pa.int64())], schema=schema)

        for b in batches:
            for group, pair, side, node, raw in zip(*(b.column(c).to_pylist() for c in ("group", "pair", "side", "node", "set"))):
                if now != (group, pair):
                    if held:
                        yield solved()
                    now, held = (group, pair), []
                held.append((side, node, raw))
        if held:
            yield solved()

    return _dealt(pairs).mapInArrow(run, "a long, b long")


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each group of similar texts: one with the group's smallest doc_id, or one without doc_id
    where all lack it; of rows that differ in other columns only, the one of the smallest hash.

    Unlike texts stay, whatever doc_ids they share or lack. All columns stay as they are, whatever names they have; an
    empty table gives no rows."""
    kept = materialize(text_groups(docs, **how).where("node = root").select("same"), "kept-texts")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tie = F.xxhash64(*(F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t))
    keyed = docs.select(F.struct(*columns).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("same"), F.col("doc_id").cast("long").alias("id"), tie.alias("tie"))
    # Tasks keep one row of each text before the shuffle, so copies don't meet in one.
    one = F.row_number().over(Window.partitionBy("same").orderBy(F.col("id").asc_nulls_last(), "tie"))
    return keyed.withColumn("place", one).where("place = 1").join(kept, "same", "left_semi").select("row.*")
