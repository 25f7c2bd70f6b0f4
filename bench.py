"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tableseek.plans import QUERIES  # noqa: E402
from tableseek.session import build_session  # noqa: E402

HEADLINE = [
    "lexical_index", "bm25_map", "bm25_topk", "postings_stats", "augmented_corpus",
    "doc_contents", "doc_roundtrip", "column_profile", "column_types",
    "capped_rows", "split_queries", "fixed_corpus", "fk_closure_sample", "aligned_sample",
    "impute_cyclic", "corrupt_cells", "hard_negatives", "candidates_visible", "train_batches",
    "size_batches", "padding_plan", "map_mrr_multi_model", "info_nce", "dense_candidates", "dense_search",
    "sql_lineage", "state_changes", "dedupe_questions", "nested_corpus", "score_global", "hybrid_ranks", "stream_state_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
            # one machine: a local folder is shared by all its executors
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not measured
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = Path(sf_dir).name.removeprefix("sf")
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
