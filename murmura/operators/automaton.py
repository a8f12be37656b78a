"""Keyword rosters as one Aho-Corasick automaton a worker: work grows with the text, not with the roster."""

from __future__ import annotations

import re
import sys
import types

import ahocorasick

_WORD = re.compile(r"[a-z0-9_]+")
#: Bounds of words in the marked form of texts and keywords: a character that text holds nowhere.
MARK, NOT_MARK = "￿", "￾"


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across the tasks it runs."""
    return sys.modules.setdefault("_murmura_rosters", types.ModuleType("_murmura_rosters")).__dict__


def marked(low: str) -> str:
    """Lower-case text with both ends of every word marked, so that a hit on a marked keyword is whole words."""
    return _WORD.sub(f"{MARK}\\g<0>{MARK}", low.replace(MARK, NOT_MARK))


class Keywords:
    """Whole-word keywords; a keyword that begins or ends in another character is bounded there by nothing."""

    def __init__(self, keywords: list[str]) -> None:
        self.tree = ahocorasick.Automaton()
        for k in keywords:
            form = marked(k)
            self.tree.add_word(form, (len(form), k))
        self.some = len(self.tree) > 0
        if self.some:
            self.tree.make_automaton()

    def spans(self, low: str) -> list[tuple[int, int, str]]:
        """(start, end, keyword) in lower-case text: leftmost, longest, not overlapping."""
        if not self.some:
            return []
        form = marked(low)
        found = sorted((end - size, -end, keyword) for end, (size, keyword) in self.tree.iter(form))
        out, done, seen, marks = [], -1, 0, 0
        for before, end, keyword in found:
            start, stop = before + 1, 1 - end
            if start < done:
                continue
            done = stop
            marks += form.count(MARK, seen, start)
            inner = form.count(MARK, start, stop)
            out.append((start - marks, stop - marks - inner, keyword))
            marks, seen = marks + inner, stop
        return out


class Phrases:
    """Phrases in normal form (lower case, one space between words): every one that a text in normal form holds."""

    def __init__(self, phrases: list[str]) -> None:
        self.tree = ahocorasick.Automaton()
        for p in phrases:
            self.tree.add_word(f" {p} ", p)
        self.some = len(self.tree) > 0
        if self.some:
            self.tree.make_automaton()

    def held(self, form: str) -> set[str]:
        """``form`` begins and ends with a space."""
        return {p for _, p in self.tree.iter(form)} if self.some else set()


class Parts:
    """Texts sought anywhere in another: every one that it holds."""

    def __init__(self, parts: list[str]) -> None:
        self.empty = "" in parts
        self.tree = ahocorasick.Automaton()
        for p in filter(None, parts):
            self.tree.add_word(p, p)
        self.some = len(self.tree) > 0
        if self.some:
            self.tree.make_automaton()

    def held(self, low: str) -> set[str]:
        found = {p for _, p in self.tree.iter(low)} if self.some else set()
        return found | {""} if self.empty else found


def of_worker(kind: type, key: object, phrases: list[str]) -> Keywords | Phrases | Parts:
    """The worker's automaton of a broadcast roster, built on first use; the store holds the last few rosters."""
    store = worker_store().setdefault("rosters", {})
    if (kind.__name__, key) not in store:
        while len(store) >= 4:
            store.pop(next(iter(store)))
        store[kind.__name__, key] = kind(phrases)
    return store[kind.__name__, key]
