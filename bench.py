"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully materialised with the ``noop`` sink (every row computed,
nothing collected) and timed separately.
"""
import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hazardlake.plans.queries import registry  # noqa: E402
from hazardlake.session import get_spark  # noqa: E402

HEADLINE = [
    "entity_features", "indicator_pivot_binary", "train_table", "aligned_test_table", "text_flags",
    "rule_flags", "char_ngram_tfidf", "describe", "kfold", "stratified_split", "rank_ensemble",
    "km_censoring", "ipcw_weights", "ipcw_cindex", "harrell_cindex", "weight_sweep", "permutation_importance",
    "impute_scale", "target_encode", "cox_ph", "cox_terms", "boost_first_residuals", "csv_roundtrip", "cv_fixed_scores",
    # whole fits: 300 trees, 300 rounds
    "survival_forest", "boosted_survival",
]
#: After so many seconds the line is printed with the queries that have ended, and the run stops.
BUDGET = float(os.environ.get("BENCH_BUDGET", "1200"))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",")) if n] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="hazardlake-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    reg = registry()
    times = {}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")

    def report():
        done = dict(times)
        print(json.dumps({"metric": "total_query_seconds", "value": round(sum(done.values()), 3), "unit": "sec",
                          "queries": done, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}), flush=True)

    def stop():
        report()
        os._exit(0)

    watch = threading.Timer(BUDGET, stop)
    watch.daemon = True
    watch.start()
    for n in names:
        t0 = time.time()
        reg[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"{n}: {times[n]}s", file=sys.stderr, flush=True)
    watch.cancel()
    report()


if __name__ == "__main__":
    main()
