"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables, BENCH_CPUS: local cores, BENCH_QUERIES: names separated by commas.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from codeloom.plans.queries import QUERIES
from codeloom.session import build_session

HEADLINE = (
    "conv_previous conv_changed_lines conv_hunks src_file_changes src_function_spans src_changed_functions "
    "src_changed_history src_strip src_strip_changed src_restore src_update src_match_pairs pair_jaccard "
    "pair_levenshtein pair_tfidf pair_embedding box_stats success_ratio compare_runs replay_docs stream_ratio "
    "stream_functions"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "codeloom-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="codeloom-bench-"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for starting it.
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
