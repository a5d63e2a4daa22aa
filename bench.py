"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from lodestone.plans import registry
from lodestone.session import session

HEADLINE = ["idx01_ampi_segments", "join01_joinby_chain", "agg05_weighted_tab", "agg13_correlations", "agg17_draw_quantiles", "agg20_auc", "doc04_tables", "doc10_manifest", "gra02_clustering", "gra06_pagerank", "gra13_18_shortest_paths", "srt07_09_sorted_arrays", "str01_incremental_load", "geo04_kriging"]


def main() -> None:
    import lodestone.plans  # noqa: F401

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["idx01_ampi_segments"](spark, sf).count()  # start-up and compilation aren't counted
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
