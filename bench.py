"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import REGISTRY  # noqa: E402
from gridloom.session import build_session  # noqa: E402

HEADLINE = [
    "s_overlap_points",
    "a_cell_gene_counts",
    "m_depth_normalize",
    "a_gene_correlation",
    "j_training_points",
    "j_knn_radius",
    "j_pip_contains",
    "j_candidates",
    "a_buffered_counts",
    "q_quadtree_leaves",
    "q_quadtree_label",
    "p_tile_predict",
    "p_partition_edges",
    "w_keep_best_rows",
    "m_yen_thresholds",
    "m_assign",
    "v_contamination_scores",
    "e_load_assigned",
    "e_boundaries_hull",
    "j_knn_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gridloom-checkpoints-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Two small queries first, so that JVM and Python worker start-up are not charged to
    # the first number.
    for name in ("s_fov_names", "g_valid_rings"):
        REGISTRY[name].run(spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
