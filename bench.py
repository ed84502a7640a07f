"""Headline queries, timed. Prints one JSON line.

Every query runs twice, collects nothing and forces all rows. The first run (``cold``)
also builds and writes the stage tables that nobody has built before it, and warms the
JVM; the second (``queries``) reads them, as the steps of a run do.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from themeloom.plans import catalog  # noqa: E402
from themeloom.runtime import local_session  # noqa: E402

HEADLINE = [
    "ingest_reviews", "clean_text", "exact_dedupe", "sentiment_scores", "source_age", "cluster_summary",
    "score", "rank_themes", "quote_sample", "citations", "near_dups", "near_dups_text", "soft_assign",
    "centroid_rank", "cohesion", "silhouette", "density_clusters", "search", "describe_by_source", "last_turns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    seconds, cold = {}, {}
    for name in names:
        for times in (cold, seconds):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries, warm", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "cold": cold, "cold_total": round(sum(cold.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
