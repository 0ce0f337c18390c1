"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hopglass.plans import load_all
from hopglass.plans.registry import QUERIES
from hopglass.session import get_session

HEADLINE = ["v05_score", "v10_summary", "v13_rescore_diff", "h05_trust_boundary", "h07_authenticated_origin", "h14_chain_discontinuity",
            "n04_origin_anonymized", "n08_geo", "d07_brand_lookalike", "a08_dmarc_fail_strict", "c11_intents", "c04_obfuscation_report",
            "f05_footprint_lane", "g04_related_prior", "g07_components", "g10_cohesion", "g16_shared_iocs", "q06_buckets", "q09_trend",
            "s02_parse_messages", "s08_anchors", "t05_tracked_mail", "i01_build_chain"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = get_session("bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="12g",
                        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
