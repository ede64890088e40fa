"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores. Every query is
run to the end with all its rows and columns produced and dropped.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "prototype_classify", "per_class_f1", "spearman", "class_histogram", "hierarchy_join",
    "global_index", "vocab", "batchify", "bptt_windows", "pack_fixed", "sliding_windows",
    "length_band", "split_three_way", "chatml_render", "mlm_mask", "repeat_factor",
    "nbest_spans", "squad_em_f1", "corpus_bleu", "entity_f1",
    "pairwise_iou", "nms", "interpolated_ap", "panoptic_quality",
    "best_so_far", "ema", "leaderboard", "topk_pool", "knn_topk", "upsert_by_key",
]


def main() -> None:
    from datasheaf.plans import QUERIES
    from datasheaf.session import get_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
