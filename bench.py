"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every timed run starts from the input: kept plans and inventories are forgotten before it. ``cold`` is the first run of
a query, ``queries`` the median of the next three (one, where the first took over ``SLOW`` seconds); ``kept`` is one more
run that may read the observation tables written by the one before, as a session that asks several things does.
``scanned_mb`` is the size of the input tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sightline.plans.queries import NET, QUERIES, forget
from sightline.session import close_run, contents, get_spark

HEADLINE = [
    "endpoints", "parameters", "findings", "tech", "host_scorecard", "secret_scan", "signature_scan", "pii_card", "html_comments", "cors_findings",
    "jwt_weakness", "js_assets", "js_links", "snapshot_diff", "replay_matrix", "body_similarity", "session_discovery", "global_search", "search_rows", "traffic_windows",
]
SLOW = 10


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["host_of"](spark, sf).write.format("noop").mode("overwrite").save()

    def seconds(name: str, anew: bool = True) -> float:
        if anew:
            forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold, times, kept = {}, {}, {}
    for name in HEADLINE:
        cold[name] = seconds(name)
        times[name] = round(statistics.median(seconds(name) for _ in range(1 if cold[name] > SLOW else 3)), 3)
        kept[name] = seconds(name, anew=False)
    total = lambda x: round(sum(x.values()), 3)
    size = sum(f[1] for f in contents(spark, *(f"{sf}/{t}.parquet" for t in NET))) / 1e6
    print(json.dumps({
        "metric": "headline_total", "value": total(times), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
        "cold_total": total(cold), "cold": cold, "kept_total": total(kept), "kept": kept, "scanned_mb": round(size, 1),
    }))
    close_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
