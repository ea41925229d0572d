"""Headline timings. Prints one JSON line.

Stored stages are forgotten before every query, so each figure holds all work from the source
tables to the last row. With BENCH_MODELS=1 the two ensembles are trained as well (several minutes
at sf0.1, almost all of it job scheduling of the tree learners).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import load_catalogue  # noqa: E402
from tidewatch.plans.data import forget_stages  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    "customer_features", "stratified_split", "population_benchmarks", "impute_median", "roc_auc",
    "classification_report", "top5_reasons", "match_benchmarks", "build_prompt", "parse_reply",
    "reply_metrics", "action_verbs", "seeded_sample",
]
MODEL_STEPS = ["train_random_forest", "train_boosted_trees", "enriched_customers"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load_catalogue()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str) -> None:
        start = time.perf_counter()
        catalogue[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        forget_stages(spark)
        timed(name)
    forget_stages(spark)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    for name in MODEL_STEPS if os.environ.get("BENCH_MODELS", str(int(scale == "0.01"))) == "1" else []:
        timed(name)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
