"""I-Match fingerprints over randomised lexicon subsets.

Terms within a band of inverse document frequency form the lexicon. A document's distinct lexicon terms are sorted and
hashed: once as a whole, and once for each of several random subsets of the lexicon. Subsets are drawn at halving
rates; a fingerprint holds the two levels at which a document of its size keeps about one term a subset, so that
likeness of edited texts shows at any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import materialize

SUBSETS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
FLUSH = 400_000


def terms_of(text: str) -> set[bytes]:
    return set(text.encode().lower().split())


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (XXH64 of the lower-cased word, as a signed long) and df over all texts; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
            n = np.fromiter(seen.values(), np.int64, len(seen))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["term", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                for w in terms_of(t or ""):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > FLUSH:
                    yield flushed()
                    seen.clear()
        yield flushed()

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, *, low: float = 0.0005, high: float = 0.2, most: int = 32_000_000) -> np.ndarray:
    """Sorted hashes of the terms whose document frequency lies from ``low`` to ``high`` of all documents.

    Document frequencies sum to documents times mean distinct terms u, so the lexicon has at most u / low terms
    whatever the corpus holds; above ``most`` it is refused rather than broadcast. It is a sorted array of 8 bytes a term (at
    most 256 MB) at the driver and in each worker, where terms are looked up by binary search."""
    n = docs.count()
    band = document_frequencies(docs).where(F.col("df").between(math.ceil(low * n), math.floor(high * n))).select("term")
    band = materialize(band, "lexicon")
    if (held := band.count()) > most:
        raise ValueError(f"{held} terms in the band: raise `low`")
    found = np.asarray(band.toArrow().column("term"), np.int64)
    return np.sort(found.view(np.uint64))


class Fingerprinter:
    """Fingerprints of texts against a lexicon: ``whole|level:hash.hash...|level+1:...``, empty subsets left blank."""

    def __init__(self, terms: np.ndarray) -> None:
        self.lexicon = terms
        self.known: dict[bytes, int | None] = {}
        self.seeds = np.arange(1, SUBSETS + 1, dtype=np.uint64) * _MIX

    def hashes(self, text: str) -> np.ndarray:
        """Sorted hashes of the text's distinct lexicon terms; a worker remembers the last words it looked up."""
        known, words = self.known, terms_of(text)
        if len(known) > FLUSH:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.lexicon, h), max(len(self.lexicon) - 1, 0))
            held = self.lexicon[at] == h if len(self.lexicon) else np.zeros(len(h), bool)
            known.update((w, x if k else None) for w, x, k in zip(new, h.tolist(), held.tolist()))
        return np.sort(np.asarray([h for w in words if (h := known[w]) is not None], np.uint64))

    def __call__(self, text: str) -> str:
        terms = self.hashes(text)
        if not len(terms):  # no term in the band: the text itself stands for it
            return "=" + hashlib.sha256(text.encode()).hexdigest()[:32]
        draw = (terms[:, None] ^ self.seeds[None, :]) * _MIX
        draw = (draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        first = max(0, round(math.log2(len(terms))))
        parts = [f"{xxhash.xxh64_hexdigest(terms.tobytes())}"]
        for level in (first, first + 1):
            kept = draw >> np.uint64(64 - level) == 0 if level else np.ones(draw.shape, bool)
            subsets = [xxhash.xxh64_hexdigest(terms[kept[:, s]].tobytes())[:8] if kept[:, s].any() else "" for s in range(SUBSETS)]
            parts.append(f"{level}:{'.'.join(subsets)}")
        return "|".join(parts)


def likeness(a: str, b: str) -> float:
    """Share of agreeing subsets among those that either document has a term in, at the levels both hold (0 to 1)."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    x, y = (dict(p.split(":") for p in f.split("|")[1:]) for f in (a, b))
    pairs = [p for k in x.keys() & y.keys() for p in zip(x[k].split("."), y[k].split(".")) if any(p)]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def fingerprint_documents(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of every row; a null text is the empty text, other columns are left aside."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(sent.value)
        for b in batches:
            prints = [make(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _ranges(cuts: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Range of each (key, tie) by descending key and ascending tie, as numbers that fall in that order.

    ``cuts`` are sorted quantiles of the keys. A key that several quantiles fall on is heavier than a range and is split by
    its ties, which are evenly spread."""
    low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
    spread = ((tie.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(11)) * 2.0**-53
    return (high - np.floor(spread * (high - low + 1)).astype(np.int64)).astype(np.int32)


def edited_fingerprints(docs: DataFrame, *, low: float = 0.0005, high: float = 0.2) -> DataFrame:
    """Fingerprint of every text and of its edited text: the last third of its code points gives way to as many first
    ones (or all) of the next document by descending doc_id; after the last comes the first.

    Null texts are empty, a null doc_id comes last, rows of one doc_id go by a hash of the text, one row alone follows
    itself, an empty table gives no rows, other columns are left aside. Texts move once, compressed and whole, into ranges
    of (doc_id, hash); each range also gets the first text of the range after it, so no range waits for another. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialize(rows.select("key", "tie"), "doc-keys")
    # One number a range reaches the driver and goes on to the tasks.
    cuts = np.asarray(sorted(keys.stat.approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges))), np.float64).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _ranges(cuts, np.asarray(b.column("key"), np.int64), np.asarray(b.column("tie"), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("key"), b.column("tie")], names=["range", "key", "tie"])

    first = F.min(F.struct(F.bitwise_not("key").alias("down"), "tie")).alias("h")
    heads = keys.mapInArrow(placed, "range int, key long, tie long").groupBy("range").agg(first)
    # One row for each range in this window.
    down = Window.orderBy(F.desc("range"))
    all_ = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("h").over(down), F.first("h").over(all_)).alias("h"))
    after = after.select("range", F.bitwise_not("h.down").alias("key"), F.col("h.tie").alias("tie"))
    follow = rows.join(F.broadcast(after), ["key", "tie"]).dropDuplicates(["range"]).select("range", F.lit(1).alias("follows"), "key", "tie", "doc_id", "text")
    sent = spark.sparkContext.broadcast(lexicon(docs, low=low, high=high))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            at = pa.array(_ranges(cuts, np.asarray(b.column("key"), np.int64), np.asarray(b.column("tie"), np.int64)))
            at = pc.coalesce(b.column("range"), at)
            small = [c.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([at, *b.columns[1:-1], pa.array(small, pa.binary())], names=["range", "follows", "key", "tie", "doc_id", "z"])

    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    schema = pa.schema([*fields, ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, d = Fingerprinter(sent.value), zstandard.ZstdDecompressor()
        held: tuple | None = None
        at: int | None = None

        def row(now: tuple, text: str, mark: str) -> tuple:
            doc, own, own_mark = now
            k = len(own) // 3
            edited = own[: len(own) - k] + text[:k]
            e = make(edited)
            return doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark, e, likeness(own_mark, e), likeness(own_mark, mark)

        for b in batches:
            out = []
            for range_, follows, doc, z in zip(*(b.column(c).to_pylist() for c in ("range", "follows", "doc_id", "z"))):
                text = d.decompress(z).decode()
                mark = make(text)
                if held is not None and at == range_:
                    out.append(row(held, text, mark))
                held, at = None if follows else (doc, text, mark), range_
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    both = rows.select(F.lit(None).cast("int").alias("range"), F.lit(0).alias("follows"), "key", "tie", "doc_id", "text").unionByName(follow)
    small = both.mapInArrow(shrink, "range int, follows int, key long, tie long, doc_id long, z binary")
    dealt = small.repartitionById(ranges, F.col("range")).sortWithinPartitions(F.desc("range"), "follows", F.desc("key"), "tie")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
