"""Licence scans by a generalised suffix automaton.

One automaton holds all licence templates word by word, whatever their number. A text streams through it once: at each
word the automaton tells the longest run of words ending there that stands in some template (the matching statistics).
Runs that cannot be made longer are anchors; anchors that follow one another in a text and in a template, with small
gaps, are chained into the span of that template which the text covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.license_templates import PHRASES, default_templates

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rules:
    """shortest: words of an anchor. gap: words that chained anchors may leave out, in the text and in the template.
    A template counts where its chain covers ``share`` of its words, or ``words`` of them and ``least`` of its words."""

    shortest: int = 4
    gap: int = 12
    share: float = 0.85
    words: int = 25
    least: float = 0.5


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class Automaton:
    """Suffix automaton of word sequences. States are numbers: ``step``, ``link``, ``size`` hold their moves, suffix links and
    longest runs; ``places`` the (sequence, end) pairs of a state's runs; ``ends`` the phrases that a state's longest run ends in."""

    def __init__(self, sequences: list[list[int]], phrases: list[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        held: list[list[tuple[int, int]]] = [[]]
        whole: list[int] = []
        for k, words in enumerate([*sequences, *phrases]):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, held)
                if k < len(sequences):
                    held[last].append((k, i))
            whole.append(last)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):  # a shorter suffix stands wherever a longer one does
            held[self.link[v]].extend(held[v])
        self.places = held
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)
        own = {v: (len(p), k) for k, (v, p) in enumerate(zip(whole[len(sequences) :], phrases))}
        for v in order:
            self.ends[v] = (*self.ends[self.link[v]], *([own[v]] if v in own else []))

    def _new(self, size: int, step: dict[int, int], link: int, held: list) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        held.append([])
        return len(self.size) - 1

    def _extend(self, last: int, w: int, held: list) -> int:
        """The state of the sequence read so far and the word w, added where the automaton lacks it."""
        if w in self.step[last]:
            at = self.step[last][w]
            return at if self.size[at] == self.size[last] + 1 else self._split(last, w, held)
        new = self._new(self.size[last] + 1, {}, 0, held)
        while last >= 0 and w not in self.step[last]:
            self.step[last][w] = new
            last = self.link[last]
        if last >= 0:
            at = self.step[last][w]
            self.link[new] = at if self.size[at] == self.size[last] + 1 else self._split(last, w, held)
        return new

    def _split(self, last: int, w: int, held: list) -> int:
        """The runs of the state behind (last, w) that are no longer than last's and w, as a state of their own."""
        at = self.step[last][w]
        short = self._new(self.size[last] + 1, dict(self.step[at]), self.link[at], held)
        self.link[at] = short
        while last >= 0 and self.step[last].get(w) == at:
            self.step[last][w] = short
            last = self.link[last]
        return short


class Scanner:
    """Templates and phrases compiled once a worker."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], rules: Rules) -> None:
        self.rules, self.labels = rules, [label for label, _ in templates]
        self.phrase_labels = list(phrases.values())
        ids: dict[str, int] = {}
        coded = [[ids.setdefault(w, len(ids)) for w in words_of(t)] for t in [*(t for _, t in templates), *phrases]]
        self.ids, self.lengths = ids, [len(c) for c in coded[: len(templates)]]
        self.least = min([2, rules.shortest, *map(len, coded[len(templates) :])])
        self.automaton = Automaton(coded[: len(templates)], coded[len(templates) :])

    def runs(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(first, ids) of the runs of words that all stand in some template, of two words or more unless a phrase or an anchor
        may be one; matches cross no other word."""
        codes = list(map(self.ids.get, words))
        first = 0
        for stop in [i for i, c in enumerate(codes) if c is None] + [len(codes)]:
            if stop - first >= max(1, self.least):
                yield first, codes[first:stop]
            first = stop + 1

    def statistics(self, first: int, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each word of a run."""
        step, link, size = self.automaton.step, self.automaton.link, self.automaton.size
        state = length = 0
        for i, c in enumerate(codes, first):
            while state and c not in step[state]:
                state = link[state]
                length = size[state]
            if c in step[state]:
                state, length = step[state][c], length + 1
            yield i, state, length

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int]]]:
        """Base places (start, phrase) and spans (template, first word, last word, covered words, anchors) of the best chains."""
        base: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}  # by template: start in the text, start in the template, words
        ends, places, shortest = self.automaton.ends, self.automaton.places, self.rules.shortest
        for first, codes in self.runs(words):
            found = [*self.statistics(first, codes), (-1, 0, 0)]
            for (i, state, length), (_, _, then) in zip(found, found[1:]):
                base += [(i - k + 1, phrase) for k, phrase in ends[state] if k <= length]
                if length >= shortest and then != length + 1:
                    for template, end in places[state]:
                        anchors.setdefault(template, []).append((i - length + 1, end - length + 1, length))
        return base, [s for template, found in anchors.items() for s in self.chains(template, found)]

    def chains(self, template: int, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Chains of anchors in order in text and template. Each anchor follows the earlier one that covers most so far,
        among those whose end lies within ``gap`` words before (or inside) it; anchors too far off begin a new chain."""
        anchors.sort()
        best: list[tuple[int, int, int]] = []  # covered words, first word, anchors
        longest = max(k for _, _, k in anchors)
        low, gap = 0, self.rules.gap
        spans: dict[int, tuple[int, int, int, int, int]] = {}
        for i, (at, t, k) in enumerate(anchors):
            while anchors[low][0] + longest + gap < at:
                low += 1
            best.append((k, at, 1))
            for j in range(low, i):
                at2, t2, k2 = anchors[j]
                over = max(0, at2 + k2 - at, t2 + k2 - t)
                if at2 < at and t2 < t and over < k and at - at2 - k2 <= gap and t - t2 - k2 <= gap:
                    if best[j][0] + k - over > best[i][0]:
                        best[i] = (best[j][0] + k - over, best[j][1], best[j][2] + 1)
            covered, first, n = best[i]
            if covered > spans.get(first, (0, 0, 0, 0, 0))[3]:
                spans[first] = (template, first, at + k - 1, covered, n)
        return list(spans.values())

    def accepted(self, span: tuple[int, int, int, int, int]) -> bool:
        share = span[3] / self.lengths[span[0]]
        return share >= self.rules.share or span[3] >= self.rules.words and share >= self.rules.least


def scanner(templates: Iterable[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, rules: Rules = Rules()) -> Scanner:
    return Scanner(list(templates or default_templates()), PHRASES if phrases is None else phrases, rules)


_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
    ]
)


def licence_scans(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row of ``docs`` (doc_id, text).

    Base places are all places of ``phrases``. A template whose best chain passes ``rules`` adds its label; ``spans`` has, for each
    such template that no better one overlaps, the words of the text it covers. The score is the largest share of a template
    that a chain covers, 0 if no run of ``rules.shortest`` words stands in a template. A null text is empty, a null doc_id stays null, repeated rows are scanned
    alike, texts of any length are read whole (memory: a text's words), an empty table gives no rows, other columns are left aside.
    Nothing is shuffled; the templates, a parameter of bounded size, travel with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(templates, phrases, rules)
        for b in batches:
            rows = [scan_text(scan, text or "") for text in b.column("text").to_pylist()]
            columns = list(zip(*rows)) or [()] * (len(_OUT) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:]))], schema=_OUT)

    kinds = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,template:int,first:bigint,last:bigint,covered:bigint,share:double>>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def scan_text(scan: Scanner, text: str) -> tuple:
    """The columns of one text behind doc_id."""
    words = words_of(text)
    base, spans = scan.scan(words)
    starts = [s for s, _ in base]
    named = {scan.phrase_labels[p] for _, p in base}
    share = lambda s: s[3] / scan.lengths[s[0]]
    kept: list[tuple[int, int, int, int, int]] = []
    for s in sorted(filter(scan.accepted, spans), key=lambda s: (-s[3], -share(s), s)):
        if not any(s[1] <= k[2] and k[1] <= s[2] for k in kept):
            kept.append(s)
    labels = named | {scan.labels[s[0]] for s in kept}
    told = [{"label": scan.labels[s[0]], "template": s[0], "first": s[1], "last": s[2], "covered": s[3], "share": share(s)} for s in sorted(kept, key=lambda s: s[1])]
    score = min(1.0, max(map(share, spans), default=0.0))
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), score, told,
    )
