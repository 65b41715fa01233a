"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslens.operators import inventory  # noqa: E402
from corpuslens.plans import QUERIES  # noqa: E402
from corpuslens.session import local_session  # noqa: E402
from corpuslens.sources.overlay import Tables  # noqa: E402

HEADLINE = [
    "scan_table", "classify_files", "directory_summaries", "source_revision", "resolve_selection",
    "bundle", "bundle_parts", "token_contributions", "secret_findings", "symbols", "dependencies",
    "structure_tree", "change_impact", "unified_diff", "search_lines", "rank_context", "rank_context_bm25",
    "prompt_complexity", "model_selection", "run_metrics", "run_rollup", "stream_run_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = local_session(cpus, "bench")
    # start the executors and the Parquet reader before the clock: none of the measured data is touched
    spark.read.parquet(os.path.join(sf_dir, "region.parquet")).write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    scan = Tables(spark, sf_dir).scan  # one pass over the documents: overlay, classification, hashes
    timings = {"ingest_scan": round(time.perf_counter() - start, 3)}
    files = scan.count()
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t, 3)
    # the published case: 100 directories of 1,000 tiny files, scanned and searched, cold and warm
    tiny = spark.range(100_000).selectExpr(
        "'tiny' as repo", "format_string('dir%02d/file%03d.ts', cast(id / 1000 as int), id % 1000) as path", "'export const x = 1;\\n' as content")
    for again in ("cold", "warm"):
        for name, job in (("published_scan", lambda: inventory.inventory(tiny)), ("published_path_search", lambda: inventory.path_search(tiny, "file99"))):
            t = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            timings[f"{name}_{again}"] = round(time.perf_counter() - t, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")), "files": files,
        "scan_files_per_sec": round(files / max(timings["ingest_scan"], 1e-9), 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
