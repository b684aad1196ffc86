import pytest
from pyspark.sql import functions as F

from ticketloom.functions.matching import HAS_AUTOMATON, match_rules
from ticketloom.functions.rules import STARTER_RULES, RuleBase
from ticketloom.operators import label as L
from ticketloom.plans.views import MESSAGES, ticket_view

CASES = [
    ("can't login", "Account", 0.95),
    ("can t login", "Account", 0.95),
    ("help", "General Inquiry", 0.5),
    (None, "General Inquiry", 0.5),
    ("xyzzy plugh", "General Inquiry", 0.5),
    ("double charge on my package", "Billing", 0.95),
]


@pytest.mark.parametrize("native", [True, False])
def test_categorize_literals(spark, native):
    if not native and not HAS_AUTOMATON:
        pytest.skip("no automaton library")
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, t string")
    got = {r["id"]: (r["category"], r["confidence"]) for r in L.categorize(df, "t", native=native).collect()}
    assert got == {i: (c, p) for i, (_, c, p) in enumerate(CASES)}


@pytest.mark.skipif(not HAS_AUTOMATON, reason="no automaton library")
def test_both_matchers_agree(spark):
    extra = ["credit-card credit cardx", "delivery_x delivery", "éorder order\xa0", "2fa", "x\x01order", "a" * 50]
    texts = [m for m, _ in MESSAGES if m] + extra
    df = spark.createDataFrame([(t.lower(),) for t in texts], "t string")
    a = df.select("t", match_rules(F.col("t"), STARTER_RULES, native=True).alias("m")).collect()
    b = df.select("t", match_rules(F.col("t"), STARTER_RULES, native=False).alias("m")).collect()
    assert {r["t"]: (r["m"]["phrase"], list(r["m"]["scores"])) for r in a} == {
        r["t"]: (r["m"]["phrase"], list(r["m"]["scores"])) for r in b
    }


@pytest.mark.parametrize("native", [True, False])
def test_one_keyword_in_two_categories_and_ties(spark, native):
    rules = RuleBase.from_dict(
        {
            "B": {"primary": [], "secondary": ["delay"], "tertiary": ["late"], "weight": 2.0},
            "A": {"primary": ["ship"], "secondary": ["delay"], "weight": 2.0},
        },
        {},
    )
    df = spark.createDataFrame([(1, "a delay here"), (2, "shipping was late"), (3, "ship now late")], "id int, t string")
    got = {r["id"]: (r["category"], r["confidence"]) for r in L.categorize(df, "t", rules, native).collect()}
    assert got == {1: ("B", 0.5), 2: ("A", 0.8), 3: ("A", 6 / 7)}


def test_rule_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules")
    STARTER_RULES.to_frame(spark).write.csv(path, header=True)
    read = RuleBase.read(spark, path, dict(STARTER_RULES.phrases))
    assert set(read.rules) == set(STARTER_RULES.rules)
    assert read.categories == STARTER_RULES.categories


ROUTES = [
    ("nothing special", "Fraud", 0.20, "model_low", True, "General Inquiry", "fallback", True),
    ("that was not me", "Fraud", 0.27, "model_low", True, "Fraud", "model_low", True),
    ("a stolen card", "Billing", 0.9, "keyword_match", False, "Fraud", "keyword_match", False),
    ("suspicious thing", "Billing", 0.7, "suspicious", True, "Billing", "model", False),
    ("plain", "Technical", 0.45, "normal", False, "Technical", "model", True),
    ("plain", "Other", 0.6, "normal", False, "Other", "model", False),
    ("plain", "Fraud", 0.3, "model_high", False, "Fraud", "model", False),
]


def test_fraud_detection_and_routing(spark):
    df = spark.createDataFrame([r[:3] for r in ROUTES], "t string, p string, c double")
    args = (F.col("t"), F.col("p"), F.col("c"))
    rows = df.select(L.fraud_detect(*args).alias("d"), L.route_predictions(*args).alias("r")).collect()
    got = [(r["d"]["method"], r["d"]["needs_review"], r["r"]["category"], r["r"]["method"], r["r"]["needs_review"]) for r in rows]
    assert got == [r[3:] for r in ROUTES]


def test_labels_do_not_depend_on_partitions(spark, sf_dir):
    view = ticket_view(spark, sf_dir)
    one = L.process_messages(view.coalesce(1), "event_id").collect()
    many = L.process_messages(view.repartition(7), "event_id").collect()
    assert sorted(one) == sorted(many)


def test_costly_columns_run_once(spark, sf_dir):
    plan = L.process_messages(ticket_view(spark, sf_dir), "event_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1
    # Matching follows the dedupe.
    if "ArrowEvalPython" in plan:
        assert plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_confidence_band(spark):
    df = spark.createDataFrame([(0.81,), (0.8,), (0.5,), (0.49,)], "c double")
    assert [r[0] for r in df.select(L.confidence_band(F.col("c"))).collect()] == ["auto", "review", "review", "human"]


LAST_KEYWORDS = {
    "Fraud": ("fraudulent", "hacker"),
    "Billing": ("get refund", "withdrawal"),
    "Technical": ("sync issue", "compatibility"),
    "Account": ("locked out", "restore"),
    "Delivery": ("refund shipping", "free shipping"),
    "Feature Request": ("doesn't have", "please add"),
    "Customer Support": ("escalate", "helpful agent"),
    "General Inquiry": ("why is it", "documentation"),
}


@pytest.mark.parametrize("native", [True, False])
def test_the_rule_base_is_whole_and_its_last_keywords_hit(spark, native):
    if not native and not HAS_AUTOMATON:
        pytest.skip("no automaton library")
    assert len(STARTER_RULES.rules) == 284 and len(STARTER_RULES.phrases) == 39
    listed = {c: [[r.keyword for r in STARTER_RULES.rules if (r.category, r.tier) == (c, t)] for t in ("secondary", "tertiary")] for c in LAST_KEYWORDS}
    assert {c: (s[-1], t[-1]) for c, (s, t) in listed.items()} == LAST_KEYWORDS
    rows = [(c, w, i) for c, words in LAST_KEYWORDS.items() for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "c string, t string, tier int").withColumn("m", match_rules(F.col("t"), STARTER_RULES, native=native))
    weight = {r.category: r.weight for r in STARTER_RULES.rules}
    for r in df.collect():
        assert r.m.scores[STARTER_RULES.categories.index(r.c)] >= round(weight[r.c] * (100, 50)[r.tier]), (r.c, r.t)
    only = spark.createDataFrame([("unrecognized", "Fraud"), ("voucher", "Billing"), ("in transit", "Delivery")], "t string, c string")
    assert all(r.category == r.c for r in L.categorize(only, "t", native=native).collect())
