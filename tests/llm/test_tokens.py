import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from murmura.llm import bpe_count, pieces, token_output

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a \n b", "a\n b\n\n  c", "x<|endoftext|> y <|endoftext|>", "a　 b", "a\x1c b \x85 c", "▁ ▁a b▁", "\n", "it's 'll  don't", "<s> a </s>", "日本 語  \t \r\n x", "a\n  \nb", "ﬁ ①", "word " * 20000, "x" * 3000]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(ODD)] + [(100, None, "c", 1, 2), (3, ODD[3], "c", 1, 2), (None, "no id", "c", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, ids int, n_tokens int").repartition(3)


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 20, 32])
def test_packing_round_trip_and_random_access(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    p = token_output.pack(x, bits)
    assert len(p) == -(-1000 * bits // 8)
    for start, n in ((0, 1000), (37, 500), (999, 1), (5, 0)):
        assert (token_output.unpack(p, bits, start, n) == x[start : start + n]).all()


def test_token_blocks_hold_the_library_ids(docs):
    blocks = token_output.write_token_blocks(docs, BPE)
    rows = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_token_digests(blocks).collect()), key=lambda r: r[2])
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert len(rows) == len(source) and [r[:2] for r in rows] == sorted((a, b if a else None) for a, b, _ in source)
    at, found = 0, {}
    for r, (_, _, text) in zip(rows, source):
        ids = np.asarray(library_ids([text])[0] + [0], "<u4")
        assert r[2:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        found[r[1]] = ids
    assert blocks.schema["payload"].dataType.simpleString() == "binary" and blocks.first().bits == 16


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert token_output.read_token_digests(token_output.write_token_blocks(none, BPE)).count() == 0
    assert bpe_count.token_counts(none, BPE).count() == 0
    assert pieces.encode_decode(none, MODEL).count() == 0


def test_merge_counts_equal_the_library(docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.token_counts(docs, BPE).collect())
    want = []
    for r in docs.collect():
        n = len(library_ids([r.text or ""])[0])
        want.append((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert pieces.separable(sp)
    got = pieces.encode_decode(docs, MODEL, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ids = [sp.bos_id(), *sp.encode(texts[r.doc_id]), sp.eos_id()]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
