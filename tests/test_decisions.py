"""Rules, decisions, breakers: three-valued logic and precedence by hand."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import decide, rules


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(1, 10.0, "A"), (2, None, "B"), (3, 30.0, None)], "id int, x double, c string")


@pytest.mark.parametrize(
    "expression, fires",
    [
        ({"field": "x", "op": "gt", "value": 5}, [1, 3]),
        ({"not": {"field": "x", "op": "gt", "value": 20}}, [1]),
        ({"any": [{"field": "x", "op": "gt", "value": 20}, {"field": "c", "op": "eq", "value": "B"}]}, [2, 3]),
        ({"all": [{"field": "x", "op": "lte", "value": 30}, {"field": "c", "op": "ne", "value": "Z"}]}, [1]),
        ({"field": "c", "op": "not_in", "value": ["A"]}, [2]),
        ({"field": "x", "op": "between", "value": [10, 30]}, [1, 3]),
        ({"field": "x", "op": "is_null"}, [2]),
    ],
)
def test_rules_fire_only_when_true(facts, expression, fires):
    out = rules.evaluate(facts, [rules.Rule("r", expression)])
    assert sorted(r.id for r in out.filter(F.size("matched_rules") == 1).collect()) == fires


def test_every_problem_of_a_rule_is_listed(facts):
    bad = rules.Rule("bad", {"all": [
        {"field": "nope", "op": "eq", "value": 1}, {"field": "c", "op": "gt", "value": "x"},
        {"field": "x", "op": "between", "value": [9, 1]}, {"field": "x", "op": "in", "value": []},
        {"field": "x", "op": "is_null", "value": 3}, {"any": []}]})
    with pytest.raises(rules.InvalidRule) as e:
        rules.compile_rule(bad, facts.schema)
    assert [p for p, _ in e.value.problems] == [
        "expression.all[0].field", "expression.all[1].value", "expression.all[2].value", "expression.all[3].value",
        "expression.all[4].value", "expression.all[5].any",
    ]


def _decide(spark, **over):
    base = dict(score=0.1, anomaly=0.0, fallback=False, amount=10.0, rule_override=None, breaker_open=False, frozen=False)
    base.update(over)
    df = spark.createDataFrame(
        [(1, 100, *base.values())],
        "tx_id int, t long, score double, anomaly double, fallback boolean, amount double, rule_override string, breaker_open boolean, frozen boolean",
    ).withColumn("contributions", F.expr(
        "array(named_struct('feature', 'tx_count_1h', 'shap', 0.5D), named_struct('feature', 'channel', 'shap', -0.9D), named_struct('feature', 'zzz', 'shap', 0.7D))"
    ))
    return decide.decide(df, 50).first()


def test_decision_precedence(spark):
    r = _decide(spark, score=0.85)
    assert (r.decision, r.alert, r.auto_block, r.reasons) == ("DECLINE", "HIGH", True, ["MODEL_RISK_SCORE", "VELOCITY_SPIKE"])
    r = _decide(spark, score=0.6)
    assert (r.decision, r.review_deadline) == ("HOLD", 150)
    r = _decide(spark, breaker_open=True)
    assert r.decision_tier == "MEDIUM" and r.reasons[0] == "MCC_CIRCUIT_BREAKER"
    r = _decide(spark, score=0.7, rule_override="HIGH")
    assert r.decision == "DECLINE" and r.reasons[0] == "CUSTOM_RULE"
    r = _decide(spark, score=0.99, frozen=True)
    assert (r.decision, r.reasons, r.auto_block, r.alert) == ("DECLINE", ["ACCOUNT_FROZEN"], False, None)
    r = _decide(spark, anomaly=0.95)
    assert (r.decision, r.alert, r.reasons) == ("APPROVE", "ANOMALY", [])
    r = _decide(spark, score=0.99, fallback=True, amount=2_000_000.0)
    assert (r.decision, r.reasons) == ("HOLD", ["ML_UNAVAILABLE", "AMOUNT_ABOVE_NORMAL"])


def test_breaker_opens_above_the_threshold_and_closes_after_a_clean_period(spark):
    rows = [("m", 0, 20, 1), ("m", 20, 20, 2), ("m", 40, 20, 0), ("m", 85, 5, 0)]
    df = spark.createDataFrame(rows, "mcc string, minute long, n long, fraud long")
    out = {r.minute: (r.breach, r.open, r.change) for r in decide.breakers(df, ["mcc"]).collect()}
    assert out == {0: (False, False, None), 20: (True, True, "OPENED"), 40: (False, True, None), 85: (False, False, "CLOSED")}
