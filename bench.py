"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and the cores.  ``ingest`` is measured marks to the stored star, ``store_stations``
the tables of two stations written from it; what follows reads those, as it would in use.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyspark.plans import catalog, election
from tallyspark.session import build_session

HEADLINE = (
    "ing7_vote_status",
    "agg1_votes_by_contest",
    "agg2_votes_by_contest_precinct",
    "agg10_contest_dashboard",
    "agg15_session_tallies",
    "agg16_valid_choices",
    "win2_results_report",
    "rcv2_ranked_ballots",
    "rcv3_irv_rounds",
    "rla3_contest_cells",
    "rla4_cvr_export",
    "mrg2_merge_stations",
    "ver2_verify_counts",
    "dsn1_resolve_contests",
    "rvw4_ballots_where",
    "img1_sample_regions",
    "img3_novel_ink",
)


def _drain(df) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.path.abspath("spark-warehouse/staged"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}

    began = time.perf_counter()
    election.results(spark, sf_dir)
    times["ingest"] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    election.station_set(spark, sf_dir)
    times["store_stations"] = round(time.perf_counter() - began, 3)
    queries = catalog.all_queries()
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        _drain(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
