"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Each is run twice, the second counts."""

import json
import os
import time

from runlens.plans import QUERIES
from runlens.session import session

HEADLINE = [
    "leaderboard", "matrix_by_axis", "score_distribution", "tool_use_metrics", "budget_breach", "pair_arms", "generation_diff", "latest_outcome_asof",
    "preferences_best_worst", "retrieval_metrics", "stuck_loops", "ks_drift", "trace_contract", "max_concurrency", "spearman", "cliffs_delta",
    "krippendorff_alpha", "redaction_counts", "canary_leaks", "domain_keywords",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
