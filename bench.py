"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local cores.
Every query runs to its last row, with all columns, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402

try:
    from topicloom.llm import queries as _llm  # noqa: E402, F401
    from topicloom.llm.registry import QUERIES as LLM  # noqa: E402
except ImportError:
    LLM = {}
from topicloom.session import clear_scratch  # noqa: E402

HEADLINE = [
    "html_to_text", "english_only", "map_to_topics", "map_to_topics_prefix", "clean_tokens",
    "build_vocabulary", "dense_word_ids", "first_seen_index", "embedding_matrix", "token_ids",
    "sequence_features", "write_feature_json", "class_weights", "label_index", "split_report",
    "pages_with_seeds", "tf_idf", "fixed_batches", "question_features", "top2_labels",
    "sql_topic_texts", "read_pages_checked", "read_gzip_members",
    "fit_classifier", "predict_texts", "predict_pages", "stream_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    known = {**catalog.QUERIES, **LLM}
    chosen = sys.argv[1:] or [*HEADLINE, *(name for name in LLM if name.startswith("op"))]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        # One file per table would be one task: cut scans so that every core has work.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        # These files have one row group each, which no split size can cut.
        .config("spark.topicloom.spread", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Compile the code paths and start the Python workers on the smallest tables first.
    warm = Path(sf_dir).parent / "sf0.001"
    for key in chosen if warm.is_dir() else []:
        known[key](spark, str(warm)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in chosen:
        start = time.perf_counter()
        known[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
