"""The whole vector: split keys change nothing, and the plan joins no history to itself."""

from pyspark.sql import functions as F

from tidewatch.operators import features as ft
from tidewatch.operators import quality
from tidewatch.operators.hotkeys import find_hot_keys
from tidewatch.plans import tables
from tidewatch.plans.registry import FEATURES
from tidewatch.queries.features import KEYS, prior
from tidewatch.session import ROWS_A_TASK, dealt


def test_splitting_hot_keys_changes_no_feature(spark, sf, monkeypatch):
    from tidewatch.operators import quantiles as qt

    monkeypatch.setattr(qt, "BLOCK", 32)
    base = tables.payments(spark, sf)
    p = tables.with_countries(base, spark, sf)
    args = dict(
        prior=prior(base), countries=tables.countries(spark, sf), limits=tables.limits(spark, sf),
        tiers=tables.tiers(spark, sf), swaps=tables.sim_swaps(spark, sf),
        profiles=tables.profiles(spark, sf), standings=tables.standings(spark, sf),
    )
    hot = find_hot_keys(base, KEYS, "tx_id", min_rows=18, one_in=1, grain=tables.DAY)
    assert hot.found.keys() >= {"account", "agent"}
    plain, split = ft.feature_matrix(p, **args), ft.feature_matrix(p, hot=hot, **args)
    assert plain.columns == ["tx_id", *FEATURES]
    real = [f.name for f in FEATURES.values() if f.dtype == "double"]
    exact = [n for n in FEATURES if n not in real]
    # Medians are averages of two values in either path, reals agree to the last bits.
    assert quality.parity(plain, split, "tx_id", exact, real).count() == 0
    assert split.count() == base.count()


def test_the_plan_has_no_self_join(spark, sf):
    p = tables.payments(spark, sf)
    rows = ft.novelty(ft.account_history(p))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning(account") == 1


def test_only_needed_columns_are_read(spark, sf):
    p = tables.payments(spark, sf)
    plan = ft.account_history(p).select("tx_id", "tx_count_1h")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "value" not in schema and "event_type" not in schema


def test_thin_history_is_missing_not_zero(spark, sf):
    p = tables.payments(spark, sf)
    first = ft.account_history(p).filter("tx_count_7d = 0 and seconds_since_last_tx is null")
    row = first.agg(F.count("implied_speed_kmh").alias("a"), F.count("*").alias("n")).first()
    assert row.a == 0 and row.n > 0


def test_sweeps_of_large_keys_carry_their_own_columns_only(spark, sf, monkeypatch):
    seen, plain = {}, ft.sweep

    def sweep(df, key, *args, **kwargs):
        seen[key] = df
        return plain(df, key, *args, **kwargs)

    monkeypatch.setattr(ft, "sweep", sweep)
    base = tables.payments(spark, sf)
    ft.feature_matrix(
        tables.with_countries(base, spark, sf), prior=0.1, countries=tables.countries(spark, sf), limits=tables.limits(spark, sf),
        tiers=tables.tiers(spark, sf), swaps=tables.sim_swaps(spark, sf), profiles=tables.profiles(spark, sf), standings=tables.standings(spark, sf),
    )
    for key in ("counterparty", "device", "agent", "cell"):
        assert len(seen[key].columns) <= 8 and not set(seen[key].columns) & set(FEATURES), key
    assert seen["agent"].filter("agent is null").count() == seen["device"].filter("device is null").count() == 0


def test_tasks_of_wide_rows_stay_as_large_when_the_input_grows(spark):
    rows = spark.range(10)
    assert dealt(rows, "id", 10) is rows
    assert dealt(rows, "id", 10 * ROWS_A_TASK).rdd.getNumPartitions() == 10


def _reference(spark, sf):
    return dict(
        prior=0.1, countries=tables.countries(spark, sf), limits=tables.limits(spark, sf), tiers=tables.tiers(spark, sf),
        swaps=tables.sim_swaps(spark, sf), profiles=tables.profiles(spark, sf), standings=tables.standings(spark, sf))


def _few_rows(spark):
    """Payments of five accounts; an id occurs twice and another is missing."""
    p = spark.range(60).selectExpr(
        "case when id = 59 then null when id = 58 then 57 else id end as tx_id", "id % 5 as account", "id * 7200000000 as t",
        "id * 90 + 10 as cents", "cast(id * 0.9 as decimal(18,4)) as amount", "if(id % 2 = 0, 'CARD', 'AGENT_BANKING') as channel",
        "id % 7 as counterparty", "id % 4 as device", "if(id % 2 = 0, null, id % 3) as agent", "'6011' as mcc", "id / 100.0D as lat", "id / 90.0D as lon",
        "concat('c', id % 3) as cell", "id % 6 = 0 as is_fraud", "id * 7200000000 + 3600000000 as label_at", "'NATION_1' as country", "'C1' as currency",
        "'NATION_2' as counterparty_country", "1 as utc_offset_hours")
    return p.withColumn("t", F.col("t") + tables.EPOCH).withColumn("label_at", F.col("label_at") + tables.EPOCH)


def test_laid_out_rows_give_the_same_features(spark, sf, monkeypatch):
    from tidewatch import session

    p, args, rows = _few_rows(spark), _reference(spark, sf), []
    tiers = spark.range(40).selectExpr("id % 5 as account", f"{tables.EPOCH} + id * 9000000000 as effective_at", "id as version", "cast(id % 3 + 1 as int) as tier")
    for bound in (session.ROWS_A_TASK, 3):
        monkeypatch.setattr(session, "ROWS_A_TASK", bound)
        rows.append(sorted(map(str, ft.feature_matrix(p, **args | {"tiers": tiers}).collect())))
    # Two payments share an id, so each meets the statistics of both, twice.
    assert rows[0] == rows[1] and len(rows[0]) == 58 + 8


def test_laid_out_rows_stay_where_they_are_when_versions_are_looked_up(spark, sf):
    rows = ft.agent_pairs(ft.novelty(ft.account_history(_few_rows(spark).repartition(6, "account"))))
    out = ft.account_sweep(rows, None, tables.tiers(spark, sf), tables.sim_swaps(spark, sf), tables.profiles(spark, sf), 6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The rows once, and each of the three tables of versions.
    assert plan.count("Exchange hashpartitioning") == 4


def test_wide_rows_are_shuffled_by_row_alone(spark, sf):
    plan = ft.feature_matrix(_few_rows(spark), **_reference(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    top = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert sum("__row" in line for line in top) == 5 and not any("(tx_id" in line for line in top)
