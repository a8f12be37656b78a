"""Per-worker tables of distinct chunks: each distinct word of a text is tokenized once and joined back by position."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np

# A cut before a space is safe only after a character that is no white space at all.
_ODD_SPACE = re.compile(r"\s ")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across the tasks it runs."""
    return sys.modules.setdefault("_murmura_worker", types.ModuleType("_murmura_worker")).__dict__


def words_by_space(text: str) -> list[str]:
    """Split into a head and words, so that text == head + "".join(" " + w): no pre-token of a byte-level
    pattern crosses the cuts, whatever runs of white space the text has."""
    if _ODD_SPACE.search(text) is None:
        return text.split(" ")
    head, *rest = _SAFE_CUT.split(text)
    if head.startswith(" "):
        return ["", head[1:], *(p[1:] for p in rest)]
    return [head, *(p[1:] for p in rest)]


class _Known(dict):
    """word -> its ids as bytes; words not seen before wait in ``new``."""

    def __init__(self) -> None:
        self.new: dict[str, None] = {}

    def __missing__(self, word: str) -> bytes:
        self.new[word] = None
        return b""


class ChunkTable:
    """Distinct words -> ids as little-endian uint32 bytes.

    ``encode`` gets the new words of a block of texts once. The table keeps the first ``limit`` words, among them all
    frequent ones; later words are forgotten after their block, which bounds its memory and changes no result."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 900_000) -> None:
        self.encode, self.limit, self.known = encode, limit, _Known()

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """For each list of words, their ids in order."""
        known = self.known
        get = known.__getitem__
        out, redo = [], []
        for i, words in enumerate(texts):
            had = len(known.new)
            out.append(b"".join(map(get, words)))
            if len(known.new) != had or had and any(w in known.new for w in words):
                redo.append(i)
        if known.new:
            words = list(known.new)
            known.new = {}
            known.update(zip(words, self.encode(words)))
            for i in redo:
                out[i] = b"".join(map(get, texts[i]))
            if len(known) > self.limit:
                for w in words:
                    del known[w]
        return out


def id_bytes(lists: Iterable[list[int]]) -> list[bytes]:
    return [np.asarray(x, "<u4").tobytes() for x in lists]


def blocks_of(texts: Iterable[str], most: int = 300_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters in all; a longer text is a block by itself."""
    block: list[str] = []
    size = 0
    for t in texts:
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block
