import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from murmura.llm import chat, html_main, queries

SF = "/root/testdata/sf0.001"


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", r"\### Assistant: </turn> ok"), (1, 2, "assistant", "#####\\h\\\\e</turn></turn>\n"), (1, 2, "assistant", ""),
        (2, None, None, None), (2, 5, "a:b", "x\n### y"), (None, 0, "user", "no id"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "long " * 50000),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.formatted_chats(turns).withColumns({"turns": chat.read_chat(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))}).collect()
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == by
    assert {r.conv_id: r.loss for r in out} == {c: "".join(t for role, t in ts if role == "assistant") for c, ts in by.items()}
    first = next(r for r in out if r.conv_id == 1)
    assert first.formatted.count("### assistant:") == 1 and "".join(s.piece for s in first.segments) == first.formatted
    assert chat.formatted_chats(turns.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(x[i] for i in at)) for x in want.fetchall())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>%s
<aside><p>Related stories of the day</p></aside><form><p>Sign up now</p></form><section id="comments"><p>First! I think that this is the best of all</p></section>
<footer>&copy; 2024 Site</footer></body></html>"""


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><header><h1>Title &amp; more</h1></header><p>One\n two&nbsp;three<br>four</p><div class='ad'>Buy</div><p>Fi<b>v</b>e</p></article>", "Title & more One two three four Five"),
        ("<main><div class='share-bar'><a href='x'>Share</a></div><h2>Head</h2><p>Short.</p></main>", "Head Short."),
        (
            "<div><h2>Story of the town</h2><p>The mayor of the town said that the bridge will be open to all of the people in the north by the end of the year, "
            "and that it is not the last of the works on the river.</p><p>Short one.</p></div><div><a href='a'>More</a> <a href='b'>links</a> <a href='c'>here</a></div>",
            "Story of the town The mayor of the town said that the bridge will be open to all of the people in the north by the end of the year, "
            "and that it is not the last of the works on the river. Short one.",
        ),
    ],
)
def test_main_text(body, want):
    assert html_main.main_text(PAGE % body) == want


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>cut <b"), (3, "u", "<p>cut <b"), (4, "u", "<article><p>" + "long text " * 50000), (5, "u", "plain & text")]
    got = html_main.extract_pages(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 499999), (5, 12)]
    assert all(len(r.text) == r.n_chars for r in got)
    empty = html_main.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


PROSE = "The mayor of the town said that the bridge will be open to all of the people in the north by the end of the year, and that it is not the last of them. "


@pytest.mark.parametrize(
    "html, want",
    [
        # A page whose text stands beside a teaser keeps both.
        (f"<div><p>{PROSE * 3}</p></div><article><p>Teaser.</p></article>", PROSE * 3 + "Teaser."),
        # A long block in the open beside a whole article is not part of it.
        (f"<article><p>{PROSE * 9}</p></article><div>{PROSE}</div>", PROSE * 9),
        # Linked items and blocks without stop words belong to the article.
        (f"<article><p>{PROSE}</p><ul><li><a href='a'>Some source</a></li></ul><p>x1 y2 z3 {'q ' * 80}</p></article>", f"{PROSE}Some source x1 y2 z3 {'q ' * 80}"),
        # Links in the open go, and short lines between go with their neighbours.
        (f"<div><a href='a'>{'Read more here ' * 9}</a></div><div>Short</div><div><a href='b'>{'And more there ' * 9}</a></div><div>{PROSE}</div>", PROSE),
        ("<nav><a href='a'>Home</a></nav><div>Only a few words</div><footer>End</footer>", "Only a few words"),
    ],
)
def test_densities_and_neighbours_decide(html, want):
    assert html_main.main_text(html) == " ".join(want.split())


def labelled(blocks):
    """The two passes by their definitions, block by block."""
    r = html_main.Rules()
    article = sum(len(b.text) for b in blocks if b.article and not b.furniture)
    open_ = sum(len(b.text) for b in blocks if not b.article and not b.furniture)
    first = []
    for b in blocks:
        words = re.findall(r"\w+", b.text.lower())
        density = len([w for w in words if w in html_main.STOP_WORDS]) / (len(words) or 1)
        text = min(1, max(-1, (density - 0.095) / 0.055)) * min(1, len(b.text) / 140)
        links = -min(2, 4 * max(0, b.links / len(b.text) - 0.2))
        if b.furniture:
            score = text + links - (0.9 if b.loose and b.article else 3)
        elif b.article:
            score = max(0, text) + links * (0 if re.fullmatch("h[0-9]", b.tag) else 0.6 * min(1, len(b.text) / 140)) + 0.4
        else:
            score = text + links - 2 * article / max(1, article + open_)
        first.append(None if abs(score) < r.sure else score > 0)
    out = []
    for i, b in enumerate(blocks):
        known = [(abs(j - i), j) for j, x in enumerate(first) if x is not None and (not b.article or blocks[j].article and (blocks[j].loose or not blocks[j].furniture))]
        if first[i] is not None:
            out.append(first[i])
        elif not known or True not in first:
            out.append(True)
        else:
            near = [j for d, j in known if d == min(known)[0]]
            if len(near) == 2:
                heading = re.fullmatch("h[0-9]", b.tag)
                inside = blocks[near[0]].parent == b.parent and blocks[near[1]].parent != b.parent
                # Headings look ahead; others behind only if that block alone stands in the same element.
                near = [near[0]] if inside and not heading else [near[1]]
            elif re.fullmatch("h[0-9]", b.tag):
                near = [min([j for _, j in known if j > i], default=near[0])]
            out.append(first[near[0]])
    return first, out


def test_labels_equal_the_definitions():
    pages = [PAGE % f"<article><h1>Head</h1><p>{PROSE}</p><p>Short</p><div class=ad>Buy</div><p>x y z</p></article>"]
    pages += [PAGE % f"<div><h2>A</h2><p>{PROSE}</p><p>s</p></div><div><p>t</p><a href=x>{'links ' * 30}</a></div><p>u</p><h3>B</h3><p>{PROSE}</p>"]
    rng = random.Random(2)
    part = ["<p>Short line</p>", f"<p>{PROSE}</p>", "<h2>Head</h2>", "<div><a href=x>to a page</a></div>", f"<div>{'zz ' * 60}</div>", "<nav>Menu</nav>", f"<article><p>word</p><p>{PROSE}</p></article>", "<article><h4>One</h4></article>"]
    part += [f"<article><p>{PROSE}</p><div><a href=x>{'links ' * 30}</a></div><p>w</p></article>", f"<article><p>word</p><div class=share>{PROSE}</div><div class=share>Send</div></article>"]
    pages += ["".join(rng.choice(part) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    rows = duckdb.connect().execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    pages += [h or "" for (h,) in rows]
    rules = set()
    for html in pages:
        blocks = html_main.page_blocks(html)
        first, want = labelled(blocks)
        html_main.label_blocks(blocks, html_main.Rules())
        assert [b.label for b in blocks] == want, html
        assert all((b.rule in ("neighbour", "alone")) == (x is None) for b, x in zip(blocks, first))
        rules |= {b.rule for b in blocks}
    assert rules == {"stop words", "links", "prior", "neighbour", "alone"}


def planted_pages(seed, n):
    """Pages whose markup says nothing (plain divs) with the main text that they should give: running text with its headings and
    short lines, then menus of links with their headings and short labels, before and behind it."""
    rng = random.Random(seed)
    words = "bridge river council harbour market school garden station museum winter letters engine village forest letter window".split()
    stops = "the of and to in is that it was for on with as by at from this be are not".split()
    sentence = lambda: " ".join(rng.choice(stops) if rng.random() < 0.45 else rng.choice(words) for _ in range(rng.randrange(28, 40))).capitalize() + "."
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 4))).capitalize()
    menu = lambda: [f"<h3>{name()}</h3>"] + [f"<div><a href='/{rng.choice(words)}'>{' '.join(rng.sample(words, 6))}</a></div>" for _ in range(rng.randrange(3, 7))] + [f"<div>{name()}</div>"]
    out = []
    for _ in range(n):
        main, text = [f"<h2>{(title := name())}</h2>"], [title]
        for _ in range(rng.randrange(2, 6)):
            main.append(f"<p>{(said := sentence())}</p>")
            text.append(said)
            if rng.random() < 0.5:
                main.append(f"<p>{(short := name())}.</p>")
                text.append(short + ".")
        main.append(f"<p>{(last := sentence())}</p>")
        out.append(("".join([*menu(), *main, *menu()]), " ".join([*text, last])))
    return out


def test_each_rule_decides_pages_without_markup():
    pages = planted_pages(11, 200)
    right = lambda **off: sum(html_main.main_text(h, html_main.Rules(**off)) == want for h, want in pages)
    assert right() >= 190
    assert all(right(**{k: False}) < 20 for k in ("stop_words", "link_density", "neighbours"))


def test_rule_effects(spark):
    pages = spark.createDataFrame([(h,) for h, _ in planted_pages(12, 60)], "html string")
    got = {r.rule: r for r in html_main.rule_effects(pages).collect()}
    assert set(got) == {"stop words", "links", "neighbours"} and len({r.blocks for r in got.values()}) == 1
    assert all(r.labels > 60 and r.texts >= 50 for r in got.values())
    assert sum(r.blocks for r in html_main.rule_effects(pages.where("false")).collect()) == 0


def test_priors_can_be_overturned():
    links = f"<ul><li><a href=x>{'town news ' * 20}</a></li></ul>"
    assert html_main.main_text(f"<article><p>{PROSE}</p>{links}<h3><a href=y>Linked head</a></h3><p>{PROSE}</p></article>") == f"{PROSE}Linked head {PROSE}".strip()
    loose = f"<article><p>{PROSE}</p><div class='share-note'>{PROSE}</div><p>{PROSE}</p><div class='share-bar'>Send it on</div></article>"
    assert html_main.main_text(loose) == f"{PROSE}{PROSE}{PROSE}".strip()
    assert html_main.main_text(loose.replace("share-note", "comment-note")) == f"{PROSE}{PROSE}".strip()


def test_block_report(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {(r.rule, r.label): r["count"] for r in html_main.block_report(pages).groupBy("rule", "label").count().collect()}
    assert got["stop words", True] > 0 and got["links", False] > 0 and got["neighbour", True] > 0
