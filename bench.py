"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from annalist.plans import catalogue
from annalist.session import local_session

HEADLINE = ("D6_state_replay", "D1_validate_hierarchy", "D45_flatten", "J13_asof_holder", "J3_inspection", "W3_D41_overlay", "D3_A17_classify_blocks", "A10_scope_rollup", "W1_latest_run", "A5_group_count", "D33_readiness", "M2_manifest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), 8)
    took = {}
    for name in HEADLINE:
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
