"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from firstborn.session import local_session
from firstborn.workload import QUERIES

HEADLINE = [
    "flagship_stick_posteriors",
    "s1_ordered_observations",
    "s2_document_terms",
    "p3_canonical_labels",
    "a3_count_stats",
    "w5_clusters_alive",
    "w7_neighbour_candidates",
    "m7_gaussian_marginal",
    "m8_count_marginal",
    "m14_joint_score",
    "m18_leave_one_out",
    "a13_arrival_probability",
    "ps1_co_occurrence",
    "ps2_binder_losses",
    "ps3_information_losses",
    "ps4_rand_over_draws",
    "t1_map_clustering",
    "g4_alpha_posterior",
    "m20_exact_posterior",
    "g3_metropolis_fit",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf).count()  # start-up of the session is not the query's time
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
