"""The command-line entry point over a written table version."""

from __future__ import annotations

import os
import tempfile

import pytest

from worklens.__main__ import main
from worklens.sources.tables import published_versions, read_tables, write_version


def test_cli_runs_reports_and_publishes_reclassification(spark, fixture_tables):
    root = tempfile.mkdtemp(prefix="worklens-cli-")
    write_version(fixture_tables.as_dict(), root, "v0")
    common = ["--tables", os.path.join(root, "v0"), "--as-of", "2024-06-01"]
    out = os.path.join(root, "report")
    assert main(["user_month_report", *common, "--out", out, "--day-from", "2024-01-01",
                 "--day-until", "2024-04-30", "--sessions-since", "2024-01-01"]) == 0
    assert spark.read.parquet(out).count() == 60
    assert main(["browser_reclassify", *common, "--out", root, "--version", "v1"]) == 0
    assert [os.path.basename(p) for p in published_versions(spark, root)] == ["v0", "v1"]
    # The next run reads what the last one published.
    assert main(["browser_reclassify", "--tables", root, "--as-of", "2024-06-02", "--out", root, "--version", "v2"]) == 0
    first, second = (read_tables(spark, os.path.join(root, v)) for v in ("v1", "v2"))
    assert second.base.count() >= first.base.count() and second.users.count() == first.users.count()
    with pytest.raises(FileExistsError):
        main(["browser_reclassify", *common, "--out", root, "--version", "v0"])


def test_cli_keeps_sums_and_compares_names_as_told(spark, fixture_tables):
    root = tempfile.mkdtemp(prefix="worklens-cli-sums-")
    write_version(fixture_tables.as_dict(), root, "v0")
    run = ["--tables", root, "--as-of", "2024-06-01", "--day-from", "2024-01-01", "--day-until", "2024-04-30",
           "--sessions-since", "2024-01-01"]

    def out(name, job, *more):
        assert main([job, *run, *more, "--out", os.path.join(root, "out", name)]) == 0
        return spark.read.parquet(os.path.join(root, "out", name))

    plain = out("plain", "user_month_report")
    kept = out("kept", "user_month_report", "--sums", os.path.join(root, "sums"))
    assert kept.exceptAll(plain).count() == 0 and plain.exceptAll(kept).count() == 0 and plain.count() == 60
    # The lock screen is spelled otherwise than the pattern, so binary comparison keeps its time.
    nocase, binary = (out(c, "user_day_totals", "--collation", c).selectExpr("sum(sum_daily_duration)").first()[0]
                      for c in ("nocase", "binary"))
    assert binary > nocase
