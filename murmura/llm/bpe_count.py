"""Token counts by byte-pair merging over a heap and a linked list.

The lowest-rank adjacent pair is merged again and again; a chunk's count is its initial symbols less its merges. No
ids are made. Distinct words and distinct chunks are counted once for each worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.llm.chunks import blocks_of, words_by_space, worker_store

# Fixed value: the pre-token pattern of the public byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_LIMIT = 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for
    themselves, the rest follow from U+0100 in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens of words (with the space before them) for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: byte-level BPE without normalizer and prefix space is expected")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.chunks = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.by_word: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def merges(self, chunk: str) -> int:
        sym: list[str] = [self.symbols[b] for b in chunk.encode("utf-8", "surrogatepass")]
        n, rank = len(sym), self.rank
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapify(heap)
        left, right, done = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            done += 1
            sym[i], sym[j] = a + b, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heappush(heap, (r, i, sym[i], sym[k]))
            if (h := left[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heappush(heap, (r, h, sym[h], sym[i]))
        return done

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, known = 0, self.by_chunk
        for c in self.chunks.findall(text):
            n = known.get(c)
            if n is None:
                n = len(c.encode("utf-8", "surrogatepass"))
                n = known[c] = n - self.merges(c) if n > 1 else n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.by_word) > TABLE_LIMIT or len(self.by_chunk) > TABLE_LIMIT:
            self.by_word, self.by_chunk = {}, {}
        known, out = self.by_word, []
        for t in texts:
            head, *words = words_by_space(t)
            try:
                n = sum(map(known.__getitem__, words))
            except KeyError:
                for w in {w for w in words if w not in known}:
                    known[w] = self.count(" " + w)
                n = sum(map(known.__getitem__, words))
            out.append(n + self.count(head))
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    Special strings inside texts count as one token, as the library does by default. A null text is the empty text (0
    tokens) and texts of any length count whole; a null doc_id stays null; rows stay as they are, repeated ones too; an empty
    table gives no rows; columns besides doc_id and text are left aside.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if (key := f"merges:{tokenizer_path}") not in store:
            store[key] = MergeCounter(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = np.asarray([x for block in blocks_of(texts) for x in store[key].counts(block)], np.int64)
            size = np.asarray([len(t.encode()) for t in texts], np.int64)
            cols = [b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
