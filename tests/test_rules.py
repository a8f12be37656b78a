from pyspark.sql import functions as F

from murmura.functions import common, text
from murmura.operators import labels, risk


def values(spark, column, rows, names):
    return [r[0] for r in spark.createDataFrame(rows, names).select(column).collect()]


def test_levels_and_grades(spark):
    rows = [(0.0,), (25.0,), (25.04,), (50.0,), (75.0,), (75.4,), (None,)]
    assert values(spark, common.risk_level(F.col("s")), rows, "s double") == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", None]
    assert values(spark, common.grade(F.col("s")), [(90.0,), (89.9,), (40.0,), (39.9,), (None,)], "s double") == ["A+", "A", "D", "F", None]


def test_renormalised_mean_needs_weight(spark):
    mean, _ = common.renormalised([(F.col("a"), 0.3), (F.col("b"), 0.05)])
    assert values(spark, mean, [(80.0, 10.0), (None, 10.0), (60.0, None)], "a double, b double") == [(80 * 0.3 + 10 * 0.05) / 0.35, None, 60.0]


def test_reach_and_trust(spark):
    rows = [(0, 0), (None, 5), (2_000_000, 0), (76, 0)]
    got = values(spark, common.reach_modifier(F.col("v"), F.col("c")), rows, "v long, c long")
    assert got[:3] == [0.5, 1.0, 1.2] and abs(got[3] - 0.65) < 0.01
    titles = [("A - B - Reuters",), ("No suffix",), ("Tower - Devdiscourse",), (None,)]
    assert values(spark, common.trust_tier(F.col("t")), titles, "t string") == ["high", "unknown", "low", "unknown"]


def test_penalty_reading(spark):
    rows = [("Commission orders refund of Rs 12 lakh",), ("SEBI fines X Rs 3.5 crore",), ("fine of Rs 50,000 for builder",), ("nothing",), ("stay work order, 25 lakh",)]
    fields = risk.penalty_fields(F.col("t"))
    df = spark.createDataFrame(rows, "t string").select(*(c.alias(k) for k, c in fields.items())).collect()
    assert [r.amount_lakh for r in df] == [12.0, 350.0, 0.5, None, 25.0]
    assert [r.authority for r in df] == ["unknown", "senior", "unknown", "unknown", "unknown"]


def test_noise_and_floor(spark):
    rows = [("Stocks of Acme fall 4%", "rss"), ("Acme Q2 profit up", "rss"), ("Shares fall after SEBI probe", "rss"), ("Book now 3 BHK", "youtube"), ("Book now 3 BHK", "rss"), ("", "rss")]
    assert values(spark, risk.noise_reason(F.col("t"), F.col("k")), rows, "t string, k string") == ["market_move", "financial_results", None, "promotional", None, None]
    floor = risk.serious_floor(F.col("t"), F.lit("rss"), F.lit("Neutral"), F.col("r"), F.lit("Acme Homes"), F.lit(""))
    rows = [("ED probe into Acme Homes", None), ("ED probe into Acme Homes", "BYSTANDER"), ("Court drops charges against Acme", None), ("Fraud elsewhere", None)]
    assert values(spark, floor, rows, "t string, r string") == [True, False, False, False]


def test_ugc_cap(spark):
    rows = [("youtube", 99_999, "someone"), ("youtube", 100_000, "someone"), ("youtube", None, "someone"), ("youtube", 5, "NDTV India"), ("rss", 5, "x")]
    cap = risk.ugc_cap(F.col("k"), F.col("v"), F.col("a"), F.lit("allegation"))
    assert values(spark, cap, rows, "k string, v long, a string") == [True, False, True, False, False]


def test_status_answers(spark):
    status, event = risk.parse_status(F.col("t"))
    rows = [('```{"status": "probe", "event": " A  raid "}```',), ('{"status": "odd"}',), (None,)]
    got = spark.createDataFrame(rows, "t string").select(status.alias("s"), event.alias("e")).collect()
    assert [tuple(r) for r in got] == [("probe", "a raid"), (None, None), (None, None)]


def test_sentiment_rules(spark):
    rows = [("regulator lawsuit", "neutral", 0.6), ("ball in the court", "neutral", 0.9), ("court case", "negative", 0.95), ("record debt", "positive", 0.9), ("a launch", "neutral", 0.7), ("plain", "positive", 0.649), ("plain", "positive", 0.65)]
    got = labels.calibrated_sentiment(spark.createDataFrame(rows, "text string, raw_label string, raw_score double")).collect()
    assert [r.label for r in got] == ["negative", "neutral", "negative", "positive", "positive", "neutral", "positive"]
    assert [round(r.score, 6) for r in got] == [0.75, 0.9, 1.0, 0.9, 0.8, 0.649, 0.65]


def test_cleaning():
    html = "<p>Hello &amp; welcome to the long article</p><font color='#6f6f6f'>Outlet</font><p><a href='x'>Read full article</a></p>"
    assert text.clean_one(html) == "Hello & welcome to the long article"
    assert text.clean_one("<b>short</b>") == "" and text.clean_one(None) == ""


def test_names(spark):
    rows = [("Acme Homes Pvt. Ltd.",), ("Acme",), ("AB Ltd",)]
    assert values(spark, text.strip_legal_suffix(F.col("n")), rows, "n string") == ["Acme Homes", None, None]
