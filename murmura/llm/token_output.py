"""Token-ID output: fixed-width bit packing with block offsets.

Each id takes ``bits = ceil(log2(vocabulary))`` bits, least significant bit first. A file holds blocks; a block holds
whole documents and carries the offset of each, so numpy unpacks a block at once and any document alone. The blocks
are a binary column of Parquet files: Spark's commit protocol keeps half-written files of lost executors out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.chunks import ChunkTable, blocks_of, id_bytes, words_by_space, worker_store
from murmura.scratch import materialize

BLOCKS = (
    "shard int, block int, first long, n_ids int, bits int, doc_ids array<long>, doc_offsets array<int>, payload binary"
)
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids start..start+n of a block; reads only the bytes that hold them."""
    if n == 0:
        return np.zeros(0, "<u4")
    lo, hi = start * bits // 8, -(-(start + n) * bits // 8)
    part = np.frombuffer(payload, np.uint8, hi - lo, lo)
    if bits in (8, 16, 32):
        return part.view(f"<u{bits // 8}").astype("<u4")
    flat = np.unpackbits(part, bitorder="little")[start * bits - 8 * lo :][: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _tokenizer(path: str):
    key = f"tokenizer:{path}"
    store = worker_store()
    if key not in store:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        store[key] = Tokenizer.from_file(path)
    return store[key]


def _encoder(path: str):
    """Encodes lists of texts to bytes of uint32 ids; byte-level pre-tokens start at spaces, so such tokenizers go word
    by word."""
    import json

    tok = _tokenizer(path)
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    by_word = (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex")
        and not pre.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
    )

    def plain(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    if not by_word:
        return lambda texts: id_bytes(plain(texts))
    spaced = np.zeros(tok.get_vocab_size(), bool)
    spaced[[i for s, i in tok.get_vocab().items() if s.startswith("Ġ")]] = True

    def distinct(words: list[str]) -> list[bytes]:
        """New words in runs: in a run of words that hold no space, each token that starts with one starts a word."""
        clean = [w for w in words if w and " " not in w]
        found: dict[str, bytes] = {}
        for k in range(0, len(clean), 2000):
            run = clean[k : k + 2000]
            ids = np.asarray(plain([" " + " ".join(run)])[0], "<u4")
            at = (4 * np.flatnonzero(spaced[ids])).tolist()
            if len(at) == len(run):
                raw = ids.tobytes()
                found |= {w: raw[a:b] for w, a, b in zip(run, at, [*at[1:], len(raw)])}
        rest = [w for w in words if w not in found]
        found |= zip(rest, id_bytes(plain([" " + w for w in rest])))
        return [found[w] for w in words]

    store = worker_store()
    if (key := f"ids:{path}") not in store:
        store[key] = ChunkTable(distinct)

    def encode(texts: list[str]) -> list[bytes]:
        split = [words_by_space(t) for t in texts]
        heads = id_bytes(plain([s[0] for s in split]))
        return [h + r for h, r in zip(heads, store[key].join([s[1:] for s in split]))]

    return encode


def write_token_blocks(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, vocabulary: int | None = None) -> DataFrame:
    """Encode ``text`` of every row of ``docs`` (doc_id, text, ...), append ``end_id``, write packed blocks in ascending
    doc_id order and return the written blocks.

    A null text is the empty text, a null doc_id sorts first, rows of one doc_id go by a hash of the text, so that many of
    them spread over tasks, columns besides doc_id and text are left aside, and an empty table gives no blocks. A block
    closes at 65,536 ids; a text of any length is encoded whole and never split between blocks.
    """
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    bits = bits_for(max(vocabulary, end_id + 1))
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.int32())]
        + [("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int32())), ("payload", pa.binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        run = _encoder(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        first = block = held = 0
        names: list[int | None] = []
        parts: list[bytes] = []

        def closed() -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts[:-1])]).tolist()
            row = [shard, block, first, held, bits, names, offsets, pack(np.frombuffer(b"".join(parts), "<u4"), bits)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for b in batches:
            ids = iter(b.column("doc_id").to_pylist())
            for texts in blocks_of(t or "" for t in b.column("text").to_pylist()):
                for got in run(texts):
                    names.append(next(ids))
                    parts.append(got + end)
                    held += len(got) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield closed()
                        first, block, held, names, parts = first + held, block + 1, 0, [], []
        if parts:
            yield closed()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return materialize(ordered.drop("tie").mapInArrow(encode, BLOCKS), "token-blocks")


def read_token_digests(blocks: DataFrame) -> DataFrame:
    """Per document of the written blocks: doc_id, start, n_tokens, ids_crc32 (unsigned, ids as little-endian uint32)."""
    # One row for each writing task, whatever the corpus holds.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = []
                edges = [*r["doc_offsets"], r["n_ids"]]
                for doc, lo, hi in zip(r["doc_ids"], edges[:-1], edges[1:]):
                    ids = unpack(r["payload"], r["bits"], lo, hi - lo)
                    rows.append((doc, r["base"] + r["first"] + lo, hi - lo, zlib.crc32(ids.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return blocks.join(F.broadcast(base), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
