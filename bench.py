"""Time the headline queries; prints one JSON line.

Every query is run to its last row: the result goes to a sink that drops it, so nothing is
pruned as it would be by a count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from predlens import catalogue  # noqa: E402
from predlens.session import build_session  # noqa: E402

HEADLINE = [
    "annual_ratio", "historic_ratio", "rolling_100d", "rolling_transformer", "prev5_mean", "prev50_mean",
    "team_game_rates", "league_constants", "weighted_mean", "feature_table", "describe_by_class", "bin_2d",
    "pearson_pairs", "corr_ratio", "cramers_v", "ols_t", "logit_z", "dmr_cont_cont", "dmr_cont_cat",
    "dmr_cat_cat", "box_exclusive", "point_sample", "knn3", "rank_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.all_queries()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # warm start
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
