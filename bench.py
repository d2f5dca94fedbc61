"""Headline benchmark: the nine reports (R1–R9) at $BENCH_SF_DIR on local[$BENCH_CPUS].

The reports run the way they run in production: on stored domain tables. The domain tables are
derived from the star tables once (``materialize_sec``) and written under the session's checkpoint
folder, the order-keyed ones bucketed by order id into ``BENCH_CPUS`` buckets. Each report is then
built and executed in full through the ``noop`` sink (every row produced, nothing collected to the
driver), ``BENCH_RUNS`` times (default 2, fresh plan, cleared cache) — the best time counts and the
sum is ``value``. For comparison, ``queries_from_star`` times each report once when it also derives
the domain tables from the star tables. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lastmile.plans.catalog import plans, queries  # noqa: E402
from lastmile.session import checkpoint_dir, get_session  # noqa: E402
from lastmile.sources.domain import Tables  # noqa: E402
from lastmile.sources.stored import StoredTables, save_domain  # noqa: E402

HEADLINE = {
    "q1_cod_escrow_finance": "cod_escrow_finance",
    "q2_cod_escrow_logistics": "cod_escrow_logistics",
    "q3_region_coverage": "region_coverage",
    "q4_leads_by_gmv": "leads_by_gmv",
    "q5_method_mix_since_first_use": "method_mix_since_first_use",
    "q6_price_benchmark": "price_benchmark",
    "q7_leads_by_orders": "leads_by_orders",
    "q8_buyer_orders": "buyer_orders",
    "q9_method_mix": "method_mix",
}


def timed(spark, build) -> float:
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - t0
    spark.catalog.clearCache()
    return elapsed


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session(master=f"local[{cpus}]", partitions=cpus, app="lastmile-bench")
    qs, ps = queries(), plans()
    timed(spark, lambda: qs["method_mix"](spark, sf_dir))  # warm-up

    prefix = f"bench_{uuid.uuid4().hex[:8]}"
    location = f"{checkpoint_dir(spark, local_fallback=True).rstrip('/')}/{prefix}"
    t0 = time.perf_counter()
    save_domain(Tables(spark, sf_dir), prefix, location, cpus)
    materialize = time.perf_counter() - t0
    stored = StoredTables(spark, prefix, sf_dir)

    times = {key: round(min(timed(spark, lambda n=name: ps[n](stored)) for _ in range(runs)), 3)
             for key, name in HEADLINE.items()}
    from_star = {key: round(timed(spark, lambda n=name: qs[n](spark, sf_dir)), 3) for key, name in HEADLINE.items()}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "reports_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "materialize_sec": round(materialize, 3),
        "queries_from_star": from_star,
        "from_star_total_sec": round(sum(from_star.values()), 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
