"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestar.operators.tables import release  # noqa: E402
from lodestar.plans import catalog  # noqa: E402
from lodestar.plans.session import session  # noqa: E402

HEADLINE = ["rel_many_aggregates", "rel_opposite_side", "rel_group_flags", "rel_percentile_rank", "rel_outer_provenance", "text_normalise", "text_page_parts", "rank_baseline", "rank_all_models", "rank_stability", "rank_trust_tiers", "rank_contributions", "rank_bootstrap", "rank_synthesis", "report_interpretation", "rule_outcomes", "verify_structure", "verify_integrity", "score_profiles", "graph_reach"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus))
    queries = catalog.queries()
    queries["rel_filter_project"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # one to warm up, then the median of three, or of as many as end within 40 seconds
            if name != "rank_synthesis":  # which reads the intervals that rank_bootstrap has kept
                release(spark)  # every other run makes its tables anew
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            if sum(runs) > 40:
                break
        took[name] = round(sorted(runs[1:] or runs)[len(runs[1:]) // 2], 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
