"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the number of local cores. Every query counts
the corpus itself where it needs one, so each time is that of the whole job. Results go to the no-op
sink: all rows and columns are computed, none is kept.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from glyphgraph import catalogue

HEADLINES = [
    "bigram_edges",
    "bigram_top_k",
    "char_codes",
    "char_positions",
    "vertex_ids",
    "edges_with_ids",
    "graph_counts",
    "triplets",
    "weighted_comment_edges",
    "label_chars",
    "segment_text",
    "segment_slice",
    "cut_result_lines",
    "export_edges",
    "export_nodes",
    "path_ends",
    "segment_labelled",
    "pregel_components",
]

# Each query is timed this often, and the median counts.
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalogue.all_queries()

    def run(name: str, tables: str) -> float:
        start = time.perf_counter()
        registered[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # untimed: lets the JVM load and compile what the queries use, on the smallest data there is
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if not os.path.isdir(smallest):
        smallest = folder
    for name in HEADLINES:
        run(name, smallest)
    times = {name: median(run(name, folder) for _ in range(RUNS)) for name in HEADLINES}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
