"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece crosses from other characters into the white-space mark, each marked word segments by itself: distinct
words are segmented once for each worker and their ids joined back by position. Models whose pieces cross the mark, or
that normalise texts, get whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from murmura.llm.chunks import ChunkTable, blocks_of, id_bytes, worker_store

MARK = "▁"
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_PROBE = "ﬁ ①Ａ  b　c d é\t\r\n x"
FIELDS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def separable(sp) -> bool:
    """True if marked words segment by themselves under this model."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return (
        not any(MARK in p.lstrip(MARK) for p in pieces)
        and sp.piece_to_id(MARK) != sp.unk_id()
        and sp.Normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
        and sp.encode("a\nb c") == sp.encode("a\nb") + sp.encode("c")
    )


def marked_words(text: str) -> list[str]:
    """Words w with MARK + marked text == "".join(MARK + w)."""
    if "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [p[1:] for p in _CUT.split(MARK + text.replace(" ", MARK))]


def _encoder(sp, path: str):
    """Encodes lists of texts to bytes of uint32 ids."""
    store = worker_store()
    if not store.setdefault(f"separable:{path}", separable(sp)):
        return lambda texts: id_bytes(sp.encode(texts, num_threads=1))
    bare = [sp.piece_to_id(MARK)]
    if (key := f"pieces:{path}") not in store:
        store[key] = ChunkTable(
            lambda words: id_bytes(x if w else bare for w, x in zip(words, sp.encode(words, num_threads=1)))
        )
    return lambda texts: store[key].join([marked_words(t) for t in texts])


def encode_decode(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), *, bounds: bool = True) -> DataFrame:
    """doc_id and the named columns of every row: ids with begin and end id (``bounds``), and the text their decoding gives.

    ids_sha256 is over ids as little-endian unsigned 32-bit integers, decoded_sha256 over UTF-8. A null text is the
    empty text and texts of any length are encoded whole; a null doc_id stays null; rows stay as they are (no order, no
    deduplication); an empty table gives no rows; columns besides doc_id and text are left aside.
    """
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *((c, kinds[FIELDS[c]]) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if (key := f"model:{model_path}") not in store:
            import sentencepiece

            store[key] = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp = store[key]
        encode = _encoder(sp, model_path)
        begin, end = (np.asarray([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        for b in batches:
            names, done = b.column("doc_id"), 0
            for texts in blocks_of(t or "" for t in b.column("text").to_pylist()):
                out: dict[str, list] = {c: [] for c in columns}
                for raw in encode(texts):
                    if bounds:
                        raw = begin + raw + end
                    ids = np.frombuffer(raw, "<u4")
                    text = sp.decode(ids.tolist()) if {"decoded", "decoded_sha256"} & out.keys() else ""
                    for c, values in out.items():
                        if c == "n_tokens":
                            values.append(len(ids))
                        elif c == "ids":
                            values.append(ids.astype(np.int32))
                        elif c == "decoded":
                            values.append(text)
                        elif c == "ids_sha256":
                            values.append(hashlib.sha256(raw).hexdigest())
                        else:
                            values.append(hashlib.sha256(text.encode()).hexdigest())
                own = names.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(out[c], schema.field(c).type) for c in columns)], schema=schema)

    ddl = ", ".join(["doc_id long", *(f"{c} {FIELDS[c]}" for c in columns)])
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
