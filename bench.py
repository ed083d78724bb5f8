"""Times the headline queries over one data set and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.queries import QUERIES  # noqa: E402
from tidewatch.queries.features import matrix  # noqa: E402
from tidewatch.session import build  # noqa: E402

HEADLINE = [
    "f01_velocity_ratio_1h_vs_30d", "f08_unique_counterparties_24h", "f10_amount_zscore_90d",
    "f24_geo_cell_fraud_rate_30d", "f28_counterparty_confirmed_fraud_90d", "f32_accounts_per_device_7d",
    "f36_kyc_tier", "f38_dormancy_reactivation_flag", "e02_feature_separation", "e04_expanding_encoding",
    "e11_gate_table", "e20_psi", "d08_decision", "k08_circuit_breaker", "n01_t01_j05_alert_queue_page",
    "n04_n05_n06_n07_behaviour_profile", "g01_component_sizes", "h01_audit_chain",
]


def timed(run) -> float:
    started = time.time()
    run().write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    seconds = {"feature_pass": timed(lambda: matrix(spark, sf))}
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: QUERIES[n](spark, sf))
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
                "feature_rows_per_s": round(rows / seconds["feature_pass"], 1), "rows": rows, "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
