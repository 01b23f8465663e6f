"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Warm-up: every headline query once on sf0.001 (JIT, Python workers).  Then
each query runs ``BENCH_REPEAT`` times (default 3) on the bench data, forced
with the ``noop`` sink (no collect); the median wall time is reported.
Shuffle bytes written per query (first timed run) come from Spark's event
log, written to a fresh scratch folder.  Prints one JSON line.

Two queries grow with the number of distinct values instead of the rows of a
table of few names: all English words of the documents as one group
(``fuzzy_pairs_words``, ``leader_clusters_words``), run once, on the dictionary of
``BENCH_WORDS_DIR`` (default sf0.01: 33,690 words, 567 million possible pairs).
They are listed but not part of ``value``.
``joined`` is the number of pairs that the prefix filters let through to scoring.
"""

from __future__ import annotations

import glob
import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from canonspark import get_spark  # noqa: E402
from canonspark.operators import cluster as CL  # noqa: E402
from canonspark.operators import pairs as PR  # noqa: E402
from canonspark.plans import catalogue  # noqa: E402
from canonspark.sources import tables as TB  # noqa: E402

HEADLINE = ["profile_columns", "fuzzy_pairs_ratio", "leader_clusters", "first_fit_clusters",
            "majority_suggestions", "apply_category", "cleaning_summary"]
WORDS_DIR = os.environ.get("BENCH_WORDS_DIR", "/root/testdata/sf0.01")
WARMUP_DIR = "/root/testdata/sf0.001"


def _shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Sum of shuffle bytes written per job group from the event log."""
    stage_group: dict[int, str] = {}
    out: dict[str, int] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    metrics = ev.get("Task Metrics") or {}
                    written = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    if group:
                        out[group] = out.get(group, 0) + int(written)
    return out


def _word_nodes(spark):
    """The dictionary as one group of distinct values."""
    return TB.dictionary(spark, WORDS_DIR).select(
        F.lit("words").alias("group_key"), F.col("word").alias("norm"),
        F.struct(F.lit(0).alias("col_ord"), F.xxhash64("word").alias("row_id")).alias("occ"),
        F.lit(1).cast("long").alias("n"))


def _words(spark) -> tuple[dict[str, float], int]:
    nodes = _word_nodes(spark).checkpoint(eager=True)
    joined = PR.candidate_pairs(nodes, "ratio", 75).count()
    t0 = time.time()
    edges = PR.fuzzy_edges(nodes, "ratio", 75).checkpoint(eager=True)
    t1 = time.time()
    CL.cluster_values(nodes, edges, "leader").write.format("noop").mode("overwrite").save()
    return {"fuzzy_pairs_words": round(t1 - t0, 3), "leader_clusters_words": round(time.time() - t1, 3)}, joined


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    log_dir = tempfile.mkdtemp(prefix="canonspark-bench-events-")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus,
                      extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                  "spark.eventLog.compress": "false",
                                  "spark.eventLog.rolling.enabled": "false"})
    sc = spark.sparkContext

    def run(name: str, sf: str) -> float:
        t0 = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - t0

    if os.path.isdir(WARMUP_DIR):
        for name in names:
            sc.setJobGroup(f"warmup:{name}", "warm-up")
            run(name, WARMUP_DIR)
    times = {}
    for name in names:
        samples = []
        for i in range(repeat):
            sc.setJobGroup(f"{name}#{i}", name)
            samples.append(run(name, sf_dir))
        times[name] = round(statistics.median(samples), 3)
    joined = None
    if not sys.argv[1:] and os.path.isdir(WORDS_DIR):
        word_times, joined = _words(spark)
        times |= word_times
    spark.stop()
    shuffled = _shuffle_bytes(log_dir)
    shuffle = {name: shuffled.get(f"{name}#0", 0) for name in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times[n] for n in names), 3),
                      "unit": "sec", "queries": times, "shuffle_bytes": shuffle, "joined": {"fuzzy_pairs_words": joined},
                      "sf": float(m.group(1)) if m else None, "cpus": cpus, "repeat": repeat,
                      "stat": "median"}))


if __name__ == "__main__":
    main()
