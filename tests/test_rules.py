import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.operators import rules as R

FACT = "psp string, card_scheme string, account_type string, merchant_category_code bigint, capture_delay string, aci string, is_credit boolean, intracountry double, monthly_volume string, monthly_fraud_level string"
RULE = "id bigint, card_scheme string, account_type string, capture_delay string, monthly_fraud_level string, monthly_volume string, merchant_category_code bigint, is_credit boolean, aci string, fixed_amount double, rate int, intracountry double"


def random_rules(rnd, n):
    pick = lambda *xs: rnd.choice([None, None, *xs])
    return [
        (i, pick("A", "B"), pick("R", "H"), pick("<3", "manual"), pick(">8.3%"), pick("<100k", ">5m"), pick(1, 2), pick(True, False), pick("A", "B", "G"), i / 100, i, pick(0.0, 1.0))
        for i in range(n)
    ]


def random_facts(rnd, n):
    pick = lambda *xs: rnd.choice([None, *xs, *xs])
    return [
        (f"p{i}", pick("A", "B", "C"), pick("R", "H"), pick(1, 2, 3), pick("<3", "manual"), pick("A", "B", "G"), pick(True, False), rnd.choice([0.0, 1.0]), pick("<100k", ">5m"), pick(">8.3%", "<7.2%"))
        for i in range(n)
    ]


def pairwise(facts, rules):
    """The same pairs by the plain condition."""
    prefixed = rules.select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    cond = F.lit(True)
    for d in R.RULE_DIMS:
        cond = cond & (F.col(f"rule_{d}").isNull() | (F.col(f"rule_{d}") == F.col(d)))
    return facts.join(prefixed, cond, "inner")


@pytest.mark.parametrize("keys", [None, ["aci"], ["aci", "card_scheme", "is_credit"]])
def test_masked_join_equals_pairwise(spark, keys):
    rnd = random.Random(5)
    rules = spark.createDataFrame(random_rules(rnd, 60), RULE)
    facts = spark.createDataFrame(random_facts(rnd, 150), FACT)
    masked = R.wildcard_rule_join(facts, rules, key_dims=keys).select("psp", "rule_id")
    plain = pairwise(facts, rules).select("psp", "rule_id")
    a, b = sorted(map(tuple, masked.collect())), sorted(map(tuple, plain.collect()))
    assert a == b and len(a) > 100


def test_hot_tuple_joins_back_whole(spark):
    """Repeated facts, half of them with one dimension tuple that holds NULLs, keep their multiplicity."""
    rnd = random.Random(11)
    everything = (999, None, None, None, None, None, None, None, None, 0.5, 7, None)
    rules = spark.createDataFrame([*random_rules(rnd, 40), everything], RULE)
    some = random_facts(rnd, 60)
    hot = [(f"h{i % 50}", "A", None, 1, None, "A", True, 0.0, None, "<7.2%") for i in range(300)]
    facts = spark.createDataFrame(some * 5 + hot, FACT)
    got = R.wildcard_rule_join(facts, rules)
    assert got.columns == facts.columns + [f"rule_{c}" for c in rules.columns]
    counted = lambda df: sorted(map(tuple, df.groupBy("psp", "rule_id").count().collect()))
    want = counted(pairwise(facts, rules))
    assert counted(got) == want and any(r[0] == "h0" for r in want)


def test_null_fact_matches_only_wildcards(spark):
    rules = spark.createDataFrame([(1, None), (2, "A")], "id bigint, aci string")
    facts = spark.createDataFrame([("p", None)], "psp string, aci string")
    got = R.wildcard_rule_join(facts, rules, dims=["aci"]).collect()
    assert [r["rule_id"] for r in got] == [1]


def test_list_join(spark):
    rules = spark.createDataFrame(
        [(1, ["A", "A", "B"], [1]), (2, [], None), (3, None, [2, 3]), (4, ["C"], [])], "id bigint, aci array<string>, mcc array<bigint>"
    )
    facts = spark.createDataFrame([("p", "A", 1), ("q", "C", 2), ("r", None, 3)], "psp string, aci string, mcc bigint")
    dims = ["aci", "mcc"]
    got = {(r["psp"], r["rule_id"]) for r in R.list_rule_join(facts, rules, dims, dims).collect()}
    assert got == {("p", 1), ("p", 2), ("q", 2), ("q", 3), ("q", 4), ("r", 2), ("r", 3)}
    assert R.list_rule_join(facts, rules, dims, dims).count() == len(got)


def test_buckets(spark):
    df = spark.createDataFrame([(99999.99,), (100000.0,), (4999999.0,), (5000000.0,), (None,)], "v double")
    got = [r[0] for r in df.select(R.bucket_range(F.col("v"), R.VOLUME_BOUNDS, R.VOLUME_REST)).collect()]
    assert got == ["<100k", "100k-1m", "1m-5m", ">5m", ">5m"]
    delays = spark.createDataFrame([("1",), ("3",), ("5",), ("7",), ("immediate",), (None,)], "d string")
    got = [r[0] for r in delays.select(R.bucket_capture_delay(F.col("d"))).collect()]
    assert got == ["<3", "3-5", "3-5", ">5", "immediate", None]


@pytest.fixture(scope="module")
def star(spark):
    pay = spark.createDataFrame(
        [
            ("a", "m1", "S", 2023, 1, True, 100.0, "NL", "NL", "B", True),
            ("b", "m1", "S", 2023, 32, False, 50.0, None, "NL", "G", False),
            ("c", "m2", "T", 2023, 2, True, 0.0, "FR", "NL", "A", True),
        ],
        "psp_reference string, merchant string, card_scheme string, year int, day_of_year int, is_credit boolean, eur_amount double, issuing_country string, acquirer_country string, aci string, has_fraudulent_dispute boolean",
    )
    mer = spark.createDataFrame([("m1", "1", 10, "R"), ("m2", "manual", 20, "H"), ("m3", "9", 20, "H")], "merchant string, capture_delay string, merchant_category_code bigint, account_type string")
    fees = spark.createDataFrame(
        [
            (1, None, None, None, None, None, None, None, None, 1.0, 100, None),
            (2, "S", "R", "<3", None, None, 10, True, "B", 0.5, 200, 1.0),
            (3, None, "H", None, None, None, 20, None, None, 0.0, 0, None),
            (4, "Z", None, None, None, None, None, None, None, 9.0, 9, None),
        ],
        RULE,
    )
    return pay, mer, fees


def test_transaction_fees(star):
    got = {(r["payments_merchant"], r["derived_month"], r["fees_id"]): r["derived_fee_amount"] for r in R.merchant_transaction_fees(*star).collect()}
    assert got == {("m1", 1, 1): 2.0, ("m1", 1, 2): 2.5, ("m1", 2, 1): 1.5, ("m2", 1, 1): 1.0, ("m2", 1, 3): 0.0}
    totals = {(r["merchant"], r["month"]): r["total_fee"] for r in R.total_fees(*star).collect()}
    assert totals == {("m1", 1): 4.5, ("m1", 2): 1.5, ("m2", 1): 1.0}


def test_zero_volume_month(star):
    got = {(r["merchant"], r["month"]): (r["fraud_pct"], r["monthly_fraud_level"]) for r in R.monthly_merchant_stats(star[0]).collect()}
    assert got[("m2", 1)] == (None, ">8.3%") and got[("m1", 1)] == (100.0, ">8.3%") and got[("m1", 2)] == (0.0, "<7.2%")


def test_what_if(star):
    got = {r["merchant"]: r["delta"] for r in R.fee_delta_mcc_change(*star, new_mcc=99).collect()}
    assert got == {"m1": -2.5, "m2": 0.0}
    delta = {r["fees_id"]: r["delta"] for r in R.fee_delta_rate_change(*star, new_rate=0).collect()}
    assert delta == {1: -1.5, 2: -2.0, 3: 0.0}
    assert {(r["payments_merchant"]) for r in R.merchants_affected_by_fee(*star, fee_id=1, account_type="H").collect()} == {"m1"}


def test_steering(star):
    got = {(r["payments_merchant"], r["derived_target_aci"]): r["derived_total_fee"] for r in R.steering_costs(*star).collect()}
    assert got == {("m1", "B"): 2.5}
    best = {(r["merchant"], r["recommended_aci"], r["total_fee"]) for r in R.steering_recommendation(*star).collect()}
    assert best == {("m1", "A", 2.0), ("m2", "A", 1.0)}


def test_coverage_and_scope(star):
    got = {(r["kind"], r["key"]) for r in R.rule_coverage(*star).collect()}
    assert got == {("unused_rule", "4")}
    active = {r["merchant"]: r["is_active"] for r in R.dataset_scope_merchants(star[0], star[1]).collect()}
    assert active == {"m1": True, "m2": True, "m3": False}


def test_most_expensive_mcc_counts_wildcards_once(star):
    got = {r["merchant_category_code"]: (r["avg_fee"], r["is_top"]) for r in R.most_expensive_mcc(star[2], 100.0).collect()}
    # rules 1 and 4 apply to every code
    assert got[10] == (round((2.5 + 2.0 + 9.09) / 3, 6), True)
    assert got[20] == (round((0.0 + 2.0 + 9.09) / 3, 6), False)


def test_a_tuple_meets_one_row_per_mask(spark):
    """Many rules of few kinds: candidates are bounded by the wildcard masks, and pairs stay whole."""
    rnd = random.Random(3)
    some = random_rules(rnd, 30)
    rules = spark.createDataFrame([(i * 1000 + k, *r[1:]) for i, r in enumerate(some) for k in range(20)], RULE)
    facts = spark.createDataFrame(random_facts(rnd, 40), FACT)
    numbered = R.with_kinds(rules)
    met = R._met_kinds(facts, numbered).groupBy("psp").count().agg({"count": "max"}).first()[0]
    masks = {tuple(v is None for v in (*r[1:9], r[11])) for r in some}
    assert met <= len(masks) and numbered.count() == rules.count()
    assert R.wildcard_rule_join(facts, rules).count() == pairwise(facts, rules).count() == 20 * R._met_kinds(facts, numbered).count() > 0


def test_usage_joins_no_single_rules(spark):
    """The rule join behind sums per rule gets one fact per tuple and one rule per kind."""
    rules = spark.createDataFrame([(1, "A", 0.5), (2, "A", 1.5), (2, None, 1.5), (3, "B", 0.0), (4, None, 1.0)], "id bigint, aci string, rate double")
    facts = spark.createDataFrame([("A", 1.0), ("A", 2.0), (None, 4.0)], "aci string, eur_amount double")
    seen = []

    def join(groups, kinds):
        seen.append((groups.count(), kinds.count()))
        return R.wildcard_rule_join(groups, kinds, ["aci"])

    got = {r["fees_id"]: (r["pairs"], r["amount"]) for r in R.rule_usage(join, facts, rules, ["aci"]).collect()}
    assert got == {1: (2, 3.0), 2: (5, 10.0), 4: (3, 7.0)} and seen == [(2, 3)]


def test_rules_used_once(spark):
    """Ids that repeat with equal and with other dimensions come out once per group."""
    same = dict.fromkeys(R.RULE_DIMS)
    rows_ = [(1, "A"), (1, "A"), (1, None), (2, None), (None, "A"), (None, None)]
    rules = spark.createDataFrame([(i, *[{**same, "aci": a}[d] for d in R.RULE_DIMS]) for i, a in rows_], "id bigint, card_scheme string, account_type string, merchant_category_code bigint, capture_delay string, aci string, is_credit boolean, intracountry double, monthly_volume string, monthly_fraud_level string")
    groups = spark.createDataFrame([(m, "S", "R", 1, "<3", a, True, 1.0, "<100k", "<7.2%") for m, a in (("m", "A"), ("m", "B"), ("n", "B"))], "merchant string, card_scheme string, account_type string, merchant_category_code bigint, capture_delay string, aci string, is_credit boolean, intracountry double, monthly_volume string, monthly_fraud_level string")
    got = sorted(map(tuple, R.rules_used(groups, rules, ["merchant"]).collect()), key=str)
    assert got == sorted([("m", 1), ("m", 2), ("m", None), ("n", 1), ("n", 2), ("n", None)], key=str)


def test_rules_are_met_by_halves_of_the_dimensions(spark, monkeypatch):
    """No tuple of all dimensions is expanded per wildcard mask; repeated ids and rules without any dimension are kept."""
    rnd = random.Random(3)
    everything = (7, None, None, None, None, None, None, None, None, 0.5, 7, None)
    rules = spark.createDataFrame([*random_rules(rnd, 50), everything], RULE)
    facts = spark.createDataFrame(random_facts(rnd, 80), FACT).withColumn("eur_amount", F.lit(2.0))
    asked, plain = [], R.match_tuples
    monkeypatch.setattr(R, "match_tuples", lambda t, r, dims, *more: asked.append(dims) or plain(t, r, dims, *more))
    used = R.rules_used(facts, rules, ["psp"])
    want = pairwise(facts, rules)
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, want.select("psp", "rule_id").distinct().collect()))
    groups = facts.groupBy(*R.RULE_DIMS).agg(F.count(F.lit(1)).alias("txns"), F.sum("eur_amount").alias("amount"))
    total = R._with_rule_sums(groups, rules).agg(F.sum(F.col("txns") * F.col("sum_fixed")).alias("f")).first().f
    assert total == pytest.approx(want.agg(F.sum("rule_fixed_amount")).first()[0])
    assert asked and max(len(dims) for dims in asked) <= 5


def test_rules_used_tells_rules_apart_before_they_are_joined(spark):
    rng = random.Random(8)
    domains = {d: ["a", "b", None] for d in R.RULE_DIMS} | {"merchant_category_code": [1, 2, None], "is_credit": [True, False, None], "intracountry": [0.0, 1.0, None]}
    types = {"merchant_category_code": "bigint", "is_credit": "boolean", "intracountry": "double"}
    columns = ", ".join(f"{d} {types.get(d, 'string')}" for d in R.RULE_DIMS)
    pick = lambda wild: tuple(rng.choice(v if rng.random() < wild else v[:2]) for v in domains.values())
    # values of one and of several second halves, a value without a name, rules of equal dimensions, ids of several rules, one without an id
    groups = [(m, *pick(0.1)) for m in ["m1", "m2", None] for _ in range(20)] + [("alone", *pick(0.0))]
    rules = [(i % 40 if i % 7 else None if i == 7 else 100 + i, *pick(2.0)) for i in range(120)] + [(500, *[None] * 9), (500, *[None] * 9)]
    want = {(g[0], r[0]) for g in groups for r in rules if all(b is None or a == b for a, b in zip(g[1:], r[1:], strict=True))}
    frames = spark.createDataFrame(groups, f"merchant string, {columns}"), spark.createDataFrame(rules, f"id bigint, {columns}")
    for kept in (True, False):
        got = [tuple(r) for r in R.rules_used(*frames, ["merchant"], kept).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    unique = frames[1].where("id = 500").dropDuplicates()
    plan = R.rules_used(frames[0], unique, ["merchant"])._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*(_met|_kind|fees_id)", plan)  # no distinct over values and rules
