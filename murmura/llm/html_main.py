"""Main text of web pages by two-pass block rules.

Pass one weighs each block's evidence: stop-word density as far as the block is long, against link density, plus a prior
of where the block stands (in an article, in page furniture, in the open). Priors are bounded: long blocks of links within an article are
decided against it, and long running text in loosely named furniture of an article is left open. What stays ambiguous, short
blocks above all, takes in pass two the label of the nearest decided neighbour.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names, usual class words of page furniture, and stop words of four languages.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("head script style noscript template svg math iframe object select textarea button canvas audio video map datalist".split())
FURNITURE_TAGS = frozenset("nav aside footer form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead comment comments disqus reply replies cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination "
    "pager skip search form copyright".split()
)
#: Of these, the words that name a place in a layout more than what stands there.
LOOSE_WORDS = frozenset("widget toolbar skip share sharing search copyright".split())
COMMENT_WORDS = frozenset("comment comments reply replies ad ads advert sponsored related".split())
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with not but they you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur lui mais ne nous on ou par pas pour qui que sa se ses son sur un une "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch sich sie sind und von wie zu zum zur "
    "al como con del el ella ellos entre era ese eso esta este fue ha hay los las lo más muy o para pero por porque según sin sobre su sus también una y ya".split()
)
_WORD = re.compile(r"\w+")
_CUT_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*\Z")  # a tag that the page ends in


@dataclass
class Rules:
    """Evidence of pass one. Text evidence runs from -1 (no stop words) to 1 (``stop_high`` of the words or more) and counts
    in full from ``long`` characters on; link evidence runs from 0 (``link_free`` of the characters) to -2. A block is
    decided where the sum with its prior reaches ``sure`` on either side."""

    stop_low: float = 0.04
    stop_high: float = 0.15
    long: int = 140
    link_free: float = 0.2
    link_slope: float = 4.0
    sure: float = 0.5
    #: Priors. Within an article few stop words tell nothing (tables, names, formulas), and links count as far as a block is long:
    #: linked items and headings belong to it, a long block of nothing but links is a menu.
    article: float = 0.4
    article_links: float = 0.6
    furniture: float = -3.0
    #: Of furniture within an article that only a loose class word tells: long text of many stop words makes it ambiguous.
    loose: float = -0.9
    #: In the open, times the share of the page's text outside furniture that articles hold.
    beside_article: float = -2.0
    #: Rules that can be switched off, to see what each of them decides (see `rule_effects`).
    stop_words: bool = True
    link_density: bool = True
    neighbours: bool = True


@dataclass
class Block:
    text: str
    links: int
    tag: str
    furniture: bool
    article: bool
    parent: int
    loose: bool = False  # furniture by a loose class word only
    label: bool | None = field(default=None)  # True: main text, False: not, None: ambiguous
    rule: str = ""  # what decided: stop words, links, prior, neighbour, alone


class _Blocks(HTMLParser):
    """Text blocks of a page with what encloses them; unclosed elements end with an enclosing one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # tag, furniture (1: by a loose word only), article, number
        self.opened = 0
        self.silent = 0
        self.silent_tag = ""
        self.link = False
        self.parts: list[str] = []
        self.link_chars = 0
        self.tag = ""
        self.blocks: list[Block] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, furniture, article, parent = self.open[-1] if self.open else ("", 0, False, 0)
            self.blocks.append(Block(text, self.link_chars, self.tag, furniture > 0, article, parent, furniture == 1))
        self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == self.silent_tag and tag not in VOID_TAGS:
                self.silent += 1
            if not (self.silent_tag == "head" and tag == "body"):
                return
            self.silent = 0
        if tag in SILENT_TAGS:
            self.silent, self.silent_tag = 1, tag
            self.parts.append(" ")
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = True
        named = dict(attrs)
        words = set(re.split(r"[^a-z0-9]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower()))
        role = (named.get("role") or "").lower()
        inside = self.open[-1] if self.open else ("", 0, False, 0)
        article = inside[2] or tag in ("article", "main") or role in ("main", "article") or named.get("itemprop") == "articleBody"
        own, loose = False, False
        if tag == "article":
            own = bool(words & COMMENT_WORDS)
        elif tag not in ("html", "body", "main"):
            own = tag in FURNITURE_TAGS or tag == "header" and not inside[2] or role in FURNITURE_ROLES or bool(words & FURNITURE_WORDS - LOOSE_WORDS)
            loose = bool(words & LOOSE_WORDS)
            own = own or "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        level = 2 if own else 1 if loose else 0
        if tag in BLOCK_TAGS or level and tag not in VOID_TAGS:
            self.end_block()
            self.tag = tag
            # Headings and paragraphs that are no furniture enclose no other blocks.
            if tag not in VOID_TAGS and (level or tag != "p" and not (tag[:1] == "h" and tag[1:].isdigit())):
                self.opened += 1
                self.open.append((tag, max(inside[1], level), article, self.opened))

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent_tag:
                self.silent -= 1
            return
        if tag == "a":
            self.link = False
        if tag in BLOCK_TAGS or any(o[0] == tag for o in self.open):
            self.end_block()
            self.tag = ""
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.link_chars += len(data)


def page_blocks(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.end_block()
    return parser.blocks


def text_evidence(text: str, rules: Rules) -> float:
    """Stop-word density of a block between the rules' bounds, as -1 to 1, times its length up to ``long``."""
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    middle, half = (rules.stop_high + rules.stop_low) / 2, (rules.stop_high - rules.stop_low) / 2
    return max(-1.0, min(1.0, (stops - middle) / half)) * min(1.0, len(text) / rules.long)


def _heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def first_pass(b: Block, share: float, rules: Rules) -> None:
    """Label and rule of a block where its evidence suffices; ``share`` of the page's text stands in articles."""
    words = text_evidence(b.text, rules) if rules.stop_words else 0.0
    links = -min(2.0, rules.link_slope * max(0.0, b.links / len(b.text) - rules.link_free)) if rules.link_density else 0.0
    if b.furniture:
        prior = rules.loose if b.loose and b.article else rules.furniture
    elif b.article:
        told = 0.0 if _heading(b.tag) else rules.article_links * min(1.0, len(b.text) / rules.long)
        prior, words, links = rules.article, max(0.0, words), links * told
    else:
        prior = rules.beside_article * share
    total = words + links + prior
    if abs(total) >= rules.sure:
        b.label = total > 0
        # The evidence that would do without the prior, else the prior.
        own = {"links": links, "stop words": words}
        b.rule = next((k for k, x in own.items() if abs(x) >= rules.sure and (x > 0) == b.label), "prior" if (prior > 0) == b.label and prior else "stop words" if b.label else "links")


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided one; within an article, of the nearest one of that kind.

    The nearer side rules. At equal distance, headings take what follows, others what stands in the same element, else
    what follows. Without a decided neighbour, or if the page had no main text at all, a block is main text."""
    decided = [b.label for b in blocks]
    inside = [b.label if b.article and (b.loose or not b.furniture) else None for b in blocks]
    near = {False: (_nearest(decided), _nearest(decided[::-1])[::-1]), True: (_nearest(inside), _nearest(inside[::-1])[::-1])}
    empty = True not in decided
    for i, b in enumerate(blocks):
        if decided[i] is not None:
            continue
        before, after = near[b.article]
        (back, x), (ahead, y) = before[i], after[i]
        heading = _heading(b.tag)
        same = back == ahead and i >= back and blocks[i - back].parent == b.parent and blocks[min(i + ahead, len(blocks) - 1)].parent != b.parent
        first, other = (y, x) if heading or ahead < back or ahead == back and not same else (x, y)
        found = first if first is not None else other
        alone = empty or found is None
        b.label, b.rule = (True, "alone") if alone else (found, "neighbour")


def label_blocks(blocks: list[Block], rules: Rules) -> None:
    """Both passes, in place. Every block goes through them, whatever element it stands in."""
    held = {k: sum(len(b.text) for b in blocks if not b.furniture and b.article is k) for k in (True, False)}
    share = held[True] / max(1, held[True] + held[False])
    for b in blocks:
        first_pass(b, share, rules)
    if rules.neighbours:
        second_pass(blocks)
    else:  # what is left stands alone
        for b in blocks:
            b.label, b.rule = (b.label, b.rule) if b.label is not None else (not b.furniture, "alone")


def _nearest(decided: list[bool | None]) -> list[tuple[int, bool | None]]:
    """For each block, the distance and label of the nearest decided one before it (or itself)."""
    out: list[tuple[int, bool | None]] = []
    near: tuple[int, bool | None] = (len(decided) + 1, None)
    for x in decided:
        near = (0, x) if x is not None else (near[0] + 1, near[1])
        out.append(near)
    return out


def main_text(html: str, rules: Rules = Rules()) -> str:
    blocks = page_blocks(html)
    label_blocks(blocks, rules)
    return " ".join(b.text for b in blocks if b.label)


def extract_pages(pages: DataFrame, *, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars of every row of ``pages`` (page_id, url, html).

    A null html is empty, a null url or page_id stays null, broken or cut markup is read as far as it goes, repeated rows
    are read alike, pages of any length are read whole, an empty table gives no rows, other columns are left aside."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "", rules) for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def rule_effects(pages: DataFrame, *, rules: Rules = Rules()) -> DataFrame:
    """rule, blocks, labels, texts: how many of all blocks change their label, and of all pages their text, when a rule (stop words,
    links, neighbours) is switched off. What stays the same without a rule was not decided by it alone."""
    off = {"stop words": replace(rules, stop_words=False), "links": replace(rules, link_density=False), "neighbours": replace(rules, neighbours=False)}
    schema = pa.schema([("rule", pa.string()), ("blocks", pa.int64()), ("labels", pa.int64()), ("texts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: [0, 0, 0] for k in off}
        for batch in batches:
            for html in batch.column("html").to_pylist():
                blocks = page_blocks(html or "")
                label_blocks(blocks, rules)
                held = [b.label for b in blocks]
                for k, other in off.items():
                    for b in blocks:
                        b.label, b.rule = None, ""
                    label_blocks(blocks, other)
                    changed = sum(b.label != x for b, x in zip(blocks, held))
                    found[k] = [found[k][0] + len(blocks), found[k][1] + changed, found[k][2] + (changed > 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((k, *n) for k, n in found.items())), schema)], schema=schema)

    tasks = pages.select("html").mapInArrow(run, "rule string, blocks long, labels long, texts long")
    return tasks.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("blocks", "labels", "texts")))


def block_report(pages: DataFrame, *, rules: Rules = Rules()) -> DataFrame:
    """page_id, block (number in the page), place (article, furniture, open), rule that decided, label and n_chars of every
    block of ``pages``."""
    schema = pa.schema([("page_id", pa.int64()), ("block", pa.int32()), ("place", pa.string()), ("rule", pa.string()), ("label", pa.bool_()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                blocks = page_blocks(html or "")
                label_blocks(blocks, rules)
                rows += [(page, i, "furniture" if b.furniture else "article" if b.article else "open", b.rule, b.label, len(b.text)) for i, b in enumerate(blocks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "page_id long, block int, place string, rule string, label boolean, n_chars long"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, kinds)
