"""Headline queries, timed on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose
data and threads. The index build is timed as a query of its own; the searches
run on the stored index, as a user's would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "search_concept", "search_intersection", "search_near", "search_title", "search_contradiction",
    "search_similar", "search_circuit", "timeline", "search_concept_scan", "topk_per_query",
    "search_batch", "bm25", "term_stats", "facet_all", "corpus_breakdown", "read_many", "cite",
    "ingest_upsert", "postings_refresh", "health", "similar_batch",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from gate import inputs
    from gate.queries import REGISTERED
    from lexspark.session import builder
    from lexspark.sources.derived import derived_corpus
    from lexspark.sources.tables import Library

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        builder("bench").master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    corpus = derived_corpus(spark, sf_dir)
    # Start the JVM's compiler and the file readers, on the data of the run.
    corpus.agg({"texto": "max"}).collect()

    times = {}
    n = inputs.buckets(spark)
    roots = [inputs.folder(spark, sf_dir, f"bench{i}") for i in range(2)]
    times["index_build"] = min(timed(lambda: Library.save(corpus, root, n)) for root in roots)
    # The same on a tenth of the data tells start-up from rate.
    small = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    extra = {}
    if os.path.isdir(small) and small != sf_dir:
        few = derived_corpus(spark, small)
        times["index_build_small"] = min(timed(lambda: Library.save(few, inputs.folder(spark, small, f"small{i}"), n)) for i in range(2))
        more = corpus.count() - few.count()
        seconds = max(times["index_build"] - times["index_build_small"], 1e-3)
        extra["index_documents_per_sec"] = round(more / seconds, 1)
    inputs.library(spark, sf_dir).complete()
    # The index that `postings_refresh` refreshes is stored, too; the refresh alone is timed.
    extra["segments_build_sec"] = timed(lambda: inputs.segments(spark, sf_dir))
    for name in HEADLINE:
        run = lambda: REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        # The better of two, except for the longest one.
        times[name] = timed(run) if name == "similar_batch" else min(timed(run), timed(run))
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(os.path.basename(sf_dir).removeprefix("sf") or 0),
        "documents": corpus.count(), **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
