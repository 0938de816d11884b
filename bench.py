"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from obsweave.models import glm
    from obsweave.operators import cleaning, taxonomic, tracking
    from obsweave.plans.session import cut, local_session, tune
    from obsweave.queries import base, models, registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(local_session(cpus, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    named, _ = registry()
    flagged = []

    def flag():
        flagged.append(cut(base.flag_now(spark, sf_dir), "flagged"))
        return flagged[-1]

    headline = {
        "flag_all_records": flag,
        "flag_tracking": lambda: tracking.flag_tracking(flagged[-1]),
        "retention": lambda: tracking.retention(flagged[-1]),
        "sensitivity": lambda: tracking.sensitivity(flagged[-1]),
        "dedupe": lambda: cleaning.dedupe(base.occurrences(spark, sf_dir)),
        "hierarchy": lambda: taxonomic.hierarchy_summary(base.occurrences(spark, sf_dir)),
        "fit_negbin": lambda: glm.tidy(
            spark, {"nb": glm.fit_negbin(cut(models.design(spark, sf_dir), "design"))}
        ),
    }
    for name in ("cell_metrics_hex", "yearly", "mann_kendall", "gini_species", "accumulation_fast_hash",
                 "morans_i", "nearest_record_planar", "ks_environment"):
        headline[name] = lambda n=name: named[n](spark, sf_dir)

    base.occurrences(spark, sf_dir).count()  # start-up is not part of any query
    times = {}
    for name, fn in headline.items():
        t = time.time()
        fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)),
            }
        )
    )


if __name__ == "__main__":
    main()
