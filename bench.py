"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Each query is materialised in full (noop sink): one warm-up,
then one timed run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evraklab.session import local_session  # noqa: E402
from evraklab.testbed.queries import QUERIES  # noqa: E402

HEADLINE = (
    "platform_insights",
    "verified_examples",
    "classify_docs",
    "iban_scan",
    "normalise_ocr",
    "parse_reply",
    "math_check_items",
    "mask_text",
    "evidence_fuzzy",
    "proximity_nearest",
    "throttled_events",
    "apply_corrections",
    "decide_docs",
    "document_outcomes",
)
RUNS = 1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "12g")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
