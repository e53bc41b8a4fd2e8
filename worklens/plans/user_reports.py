"""Reports over a bundle of tables, reading only the days they show."""

from __future__ import annotations

from pyspark.sql import DataFrame

from worklens.operators import reports
from worklens.sources.tables import Tables


def user_report(t: Tables, params: reports.ReportParams, sums: DataFrame | None = None) -> DataFrame:
    """:func:`reports.user_report`; ``sums`` are kept day sums (``worklens.plans.day_sums``), if any."""
    sessions = t.between("user_session", *reports.session_window(params))
    return reports.user_report(t.detail, t.base, t.users, t.department, sessions, params, sums)
