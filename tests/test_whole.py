from types import SimpleNamespace

from murmura.operators import labels
from murmura.plans import q_text


def star(spark, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return SimpleNamespace(spark=spark, table=lambda name: df)


def test_every_document_is_dispatched_in_every_format(spark):
    got = q_text.dispatched(star(spark, [f"title {i} of the day\nbody {i}" for i in range(12)])).collect()
    assert len(got) == 72 and {(r.source_type, r.doc_id) for r in got} == {(k, i) for k in ("rss", "gdelt", "hn_algolia", "youtube", "instagram", "reddit") for i in range(12)}


def test_sentiment_rules_see_the_whole_text(spark):
    text = "A plain headline " * 10 + "\nsecond line\nthen a lawsuit"
    got = labels.calibrated_sentiment(q_text.sentiment_input(star(spark, [text, "A plain headline"]))).collect()
    assert "lawsuit" in {r.doc_id: r.trigger_words for r in got}[0]
