"""Headline timings: index build and batch search. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from rankwell import build_index, read_index, read_questions, search, write_index
from verification import inputs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session(folder: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("rankwell-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = tempfile.mkdtemp(prefix="rankwell-bench-")
    spark = session(folder)
    questions, queries = inputs.corpus(spark, SF_DIR), inputs.batch(spark, SF_DIR)
    questions.limit(1).collect()  # start the JVM's pools outside the timings

    times = {"build_index": timed(lambda: write_index(questions, f"{folder}/index"))}
    index = read_index(spark, f"{folder}/index")
    for name, sim in (("vsm", 0), ("bm25", 1), ("lm_dirichlet", 2), ("lm_jm_short", 3), ("lm_jm_long", 4)):
        times[f"search_{name}"] = timed(lambda sim=sim: search(queries, index, sim=sim).collect())
    lazy = build_index(questions, fields=("question",))
    times["search_unstored"] = timed(lambda: search(queries, lazy, sim=4).collect())
    times["append_index"] = timed(lambda: write_index(inputs.turns(spark, SF_DIR), f"{folder}/index", "append"))
    times["read_questions"] = timed(lambda: read_questions(spark, inputs.bracket_file(spark, SF_DIR)).count())
    times["search_clauses"] = timed(lambda: search(inputs.two_sided_batch(spark, SF_DIR), index, sim=0).collect())
    times["read_synonyms"] = timed(lambda: inputs.synonyms(spark, SF_DIR))
    rules = inputs.synonyms(spark, SF_DIR)
    expanded = build_index(questions, rules, fields=("question",))
    times["search_synonyms"] = timed(lambda: search(queries, expanded, sim=4, synonyms=rules).collect())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "index build and batch search",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
