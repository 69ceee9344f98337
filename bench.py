"""Headline queries at one scale, as one JSON line.

Each query is run to completion into the no-op sink; the median of three runs is reported, so that JVM start-up, code
generation and other load do not hide the work.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tallyspark import catalog
from tallyspark.session import local_session

HEADLINE = [
    "rule_share_by_client",
    "j1_first_rule_match",
    "j3_vendor_code_match",
    "c1_rule_cascade",
    "g2_loan_split",
    "a2_match_rates",
    "a9_ledger_duplicates",
    "d1_dedupe_output",
    "j13_drop_bank_rows",
    "j16_top_k_neighbours",
    "c3_similarity_cascade",
    "m11_ledger_corrections",
    "l5_block_rows",
    "s7_payee_from_description",
    "s10_fingerprint",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.load()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.time()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
