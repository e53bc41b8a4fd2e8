"""Summarise the physical plan of every registered job (writes PLANS.md).

The fixture tables of one scale factor are written in the library's table
layout (day-partitioned roll-ups) to a scratch folder and read back with
``read_tables``, so scans, pushed filters and partition filters are those of
real table reads. For each job: the tables scanned, join strategies, shuffle
exchanges of the final adaptive plan, aggregate kinds and notable operators.

    python tools/plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import collections
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md")

    from worklens import registry
    from worklens.session import local_session
    from worklens.sources.fixtures import fixture_tables
    from worklens.sources.tables import read_tables, write_version

    spark = local_session(app_name="worklens-plans")
    root = tempfile.mkdtemp(prefix="worklens-planreport-")
    write_version(fixture_tables(spark, sf_dir).as_dict(), root, "v0")
    tables = read_tables(spark, os.path.join(root, "v0"))
    registry._tables.cache_clear()
    original = registry._tables
    registry._tables = lambda s, d: tables          # every job reads the parquet-backed tables
    try:
        lines = [
            "# Physical plans of the registered jobs",
            "",
            f"Generated by `tools/plan_report.py` from `{sf_dir}` written in the library's table layout "
            "(roll-up tables partitioned by day). *scans*: tables read (with partition filter `P` / pushed "
            "filter `F`); *joins*: strategies in the chosen physical plan; *shuffles*: exchanges in the final "
            "adaptive plan (broadcast exchanges excluded); *aggregates*: hash / object-hash / sort aggregate "
            "operators (partial and final counted separately).",
            "",
            "| job | scans | joins | shuffles | aggregates | notable |",
            "|---|---|---|---|---|---|",
        ]
        for name, (job, _) in registry.JOBS.items():
            df = job(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            chosen = df._jdf.queryExecution().sparkPlan().toString()
            df.collect()
            final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            scans = []
            for line in chosen.splitlines():
                m = re.search(r"FileScan parquet .*Location: [^\[]*\[[^\]]*/([a-z_]+)\]", line)
                if m:
                    flags = ("P" if re.search(r"PartitionFilters: \[[^\]]", line) else "") + \
                            ("F" if re.search(r"PushedFilters: \[[^\]]", line) else "")
                    scans.append(m.group(1) + (f" ({flags})" if flags else ""))
            joins = collections.Counter()
            for line in chosen.splitlines():
                kind = re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin"
                                 r"|CartesianProduct)", line)
                if kind:
                    how = re.search(r"\b(Inner|LeftOuter|LeftSemi|LeftAnti|RightOuter|FullOuter|ExistenceJoin)\b",
                                    line)
                    short = {"BroadcastHashJoin": "BHJ", "SortMergeJoin": "SMJ"}.get(kind.group(1), kind.group(1))
                    joins[f"{short} {how.group(1) if how else ''}".strip()] += 1
            join_text = ", ".join(f"{n}x {k}" for k, n in sorted(joins.items()))
            shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                                      final))
            aggs = collections.Counter(re.findall(r"\b(HashAggregate|ObjectHashAggregate|SortAggregate)\(", chosen))
            agg_text = ", ".join(f"{n}x {k}" for k, n in sorted(aggs.items()))
            notable = sorted({k for k in ("WindowGroupLimit", "Window", "TakeOrderedAndProject", "Subquery",
                                          "Expand", "Generate") if re.search(rf"\b{k}\b", chosen)})
            lines.append(f"| `{name}` | {', '.join(sorted(scans))} | {join_text or '-'} | {shuffles} | "
                         f"{agg_text or '-'} | {', '.join(notable) or '-'} |")
            print(lines[-1], flush=True)
    finally:
        registry._tables = original
    with open(out, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
