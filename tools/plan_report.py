"""Summarise the executed physical plan of catalog queries (after AQE) as Markdown.

Usage: python tools/plan_report.py [sf_dir] [name ...] > PLANS.md

Per query: join strategies, exchanges, the filters pushed into each parquet scan and its read
schema, and whether any Python evaluation or cartesian product appears.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["cod_escrow_finance", "region_coverage", "leads_by_gmv", "method_mix_since_first_use", "price_benchmark",
            "leads_by_orders", "buyer_orders", "method_mix", "order_fact", "delivery_fact", "shipped_gmv",
            "buyer_gmv_by_method", "decile_threshold_gmv", "percent_rank_window", "manifest_total"]


def walk(node, acc: Counter, scans: list, cached: set | None = None) -> None:
    """Count physical operators of the executed plan, descending into AQE stages and into each
    cached (persisted) relation once."""
    cached = set() if cached is None else cached
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return walk(node.executedPlan(), acc, scans, cached)
    if "QueryStage" in name:
        return walk(node.plan(), acc, scans, cached)
    if name == "InMemoryTableScan":
        plan = node.relation().cachedPlan()
        if plan.hashCode() not in cached:
            cached.add(plan.hashCode())
            walk(plan, acc, scans, cached)
    if name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin"):
        acc[f"{name} {node.joinType().toString()}"] += 1
    else:
        acc[name] += 1
    if name.startswith("Scan parquet"):
        scans.append(node.simpleString(1000))
    children = node.children()
    for i in range(children.size()):
        walk(children.apply(i), acc, scans, cached)


def summarise(name: str, df) -> list[str]:
    acc: Counter = Counter()
    scans: list[str] = []
    walk(df._jdf.queryExecution().executedPlan(), acc, scans)
    joins = {k: v for k, v in acc.items() if "Join" in k}
    out = [f"### {name}", ""]
    out.append("- joins: " + (", ".join(f"{k} ×{v}" for k, v in sorted(joins.items())) or "none"))
    out.append(f"- shuffle exchanges: {acc['Exchange']}, broadcast exchanges: {acc['BroadcastExchange']}, "
               f"reused: {acc['ReusedExchange']}, sorts: {acc['Sort']}, windows: {acc['Window']}, "
               f"hash aggregates: {acc['HashAggregate']}, cached / checkpointed reads: "
               f"{acc['InMemoryTableScan'] + acc['Scan ExistingRDD']}, parquet scans: "
               f"{sum(v for k, v in acc.items() if k.startswith('Scan parquet'))}")
    bad = [b for b in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin") if acc[b]]
    out.append(f"- python / cartesian nodes: {', '.join(bad) if bad else 'none'}")
    seen = set()
    for sc in scans:
        table = (re.search(r"FileScan parquet \S*?((?:mk|lg)_\w+)\[", sc)
                 or re.search(r"Location: \w+\(\d+ paths?\)\[[^\]]*/(\w+?)(?:\.parquet)?\]", sc))
        pf = re.search(r"PushedFilters: (\[.*?)(?:, ReadSchema|$)", sc)
        rs = re.search(r"ReadSchema: struct<([^>]*)>", sc)
        pf_s = pf.group(1) if pf else "[]"
        real = [f for f in re.findall(r"(\w+)\(", pf_s) if f != "IsNotNull"]
        key = (table.group(1) if table else "?", pf_s)
        if real and key not in seen:
            seen.add(key)
            cols = f"{len(rs.group(1).split(','))} columns read" if rs else "narrow read schema"
            out.append(f"- scan `{key[0]}` ({cols}): pushed `{pf_s[:160]}`")
    out.append("")
    return out


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if not a.startswith(("/", "--"))] or HEADLINE
    import uuid

    from lastmile.plans.catalog import plans, queries
    from lastmile.session import checkpoint_dir, get_session
    from lastmile.sources.domain import Tables
    from lastmile.sources.stored import StoredTables, save_domain

    spark = get_session()
    print(f"# Executed plans ({sf_dir}, local mode, after AQE)\n")
    print("Generated by `tools/plan_report.py`: operators of each executed plan after AQE, including each "
          "persisted intermediate once. Roll-ups checkpointed into the session's checkpoint folder show "
          "as checkpointed reads (their plans ran in an earlier job).\n")
    print("Reading notes: no Python evaluation, cartesian product or nested-loop join anywhere; the order "
          "window reaches the `orders` scan as pushed filters and each scan reads only the columns it needs; "
          "dimension and small derived sides are broadcast (AQE converts further joins from measured sizes at "
          "this scale — at 100 TB the order-keyed facts stay sort-merge joins on order id); the decile reports "
          "read a checkpointed roll-up, so the threshold and the lead join do not recompute the fact. Filters on "
          "fulfilment months and batch dates apply to tables the fixture derives by aggregation, so they run "
          "after that aggregate when deriving from the star tables; on stored domain tables (second section) "
          "they reach the scans as well.\n")
    sections = [("From the star tables (each query derives its domain tables)", lambda n: queries()[n](spark, sf_dir))]
    if "--stored" in argv:
        prefix = f"plans_{uuid.uuid4().hex[:8]}"
        save_domain(Tables(spark, sf_dir), prefix, f"{checkpoint_dir(spark, local_fallback=True).rstrip('/')}/{prefix}", 8)
        stored = StoredTables(spark, prefix, sf_dir)
        sections.append(("On stored domain tables (order-keyed tables bucketed by order id, 8 buckets)",
                         lambda n: plans()[n](stored)))
    for title, build in sections:
        print(f"## {title}\n")
        for name in names:
            df = build(name)
            df.write.format("noop").mode("overwrite").save()
            print("\n".join(summarise(name, df)))
            spark.catalog.clearCache()


if __name__ == "__main__":
    main(sys.argv)
