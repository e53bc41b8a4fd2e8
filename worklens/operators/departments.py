"""Department productivity: time per department, user, position, resource
and productivity type, restricted to the users a viewer may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import NOCASE, Names, name_key, ntz

# Fixed labels of the department report (types outside 0..3 get no label).
TYPE_LABELS = {0: "Undefined", 1: "Productive", 2: "Distracting", 3: "Neutral"}


def type_label(ptype: Column) -> Column:
    out = None
    for code, label in TYPE_LABELS.items():
        out = F.when(ptype == code, F.lit(label)) if out is None else out.when(ptype == code, F.lit(label))
    return out


def department_productivity(detail: DataFrame, daily: DataFrame, users: DataFrame, department: DataFrame,
                            base: DataFrame, visible: DataFrame, date_from, date_until,
                            dates_agree: bool = False, compare: Names = NOCASE) -> DataFrame:
    """Sums of Undefined/Productive/Distracting/Neutral and total time per
    (department, user name, position, resource name, type label), for detail
    rows whose parent day lies in ``[date_from, date_until]`` (both inclusive)
    and whose user is visible and has a department.

    The label has no fallback: other or NULL types get a NULL label and count
    in the total only. Names group by what they are equal by (``compare``), so
    homonyms merge.

    ``dates_agree`` says that every detail row has its parent day's date (see
    :func:`detail_date_mismatch`); the window then bounds the detail scan as
    well, which prunes its day partitions.

    Plan: detail rows are summed per (parent day, user, resource, type) before
    any join. The sums are semi-joined to the visible users and then to the
    parent days of the window; the last of these keys is not hot and the next
    aggregate needs another shuffle, so AQE can split either join.
    """
    in_window = daily.where(F.col("date").between(ntz(date_from), ntz(date_until))).select(
        F.col("oid").alias("user_productivity_daily")
    )
    if dates_agree:
        detail = detail.where(F.col("date").between(ntz(date_from), ntz(date_until)))
    ptype = F.col("adjusted_productivity_type")
    duration = F.col("daily_duration")

    def typed(code: int) -> Column:
        return F.sum(F.when(ptype == code, duration).otherwise(F.lit(0)))

    sums = ["sum_undefined", "sum_productive", "sum_distracting", "sum_neutral", "sum_daily"]
    per_parent_day = detail.groupBy(
        "user_productivity_daily", "system_user", "productivity_base", "adjusted_productivity_type"
    ).agg(
        typed(0).alias("sum_undefined"), typed(1).alias("sum_productive"),
        typed(2).alias("sum_distracting"), typed(3).alias("sum_neutral"),
        F.sum(duration).alias("sum_daily"),
    )
    per_user_resource = (
        per_parent_day.join(visible.select("system_user"), "system_user", "left_semi")
        .join(in_window, "user_productivity_daily", "left_semi")
        .groupBy("system_user", "productivity_base", "adjusted_productivity_type")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    accounts = users.select(
        F.col("oid").alias("system_user"), F.col("name").alias("username"),
        F.col("comment").alias("position"), "working_department",
    )
    departments = department.select(F.col("oid").alias("working_department"), F.col("name").alias("department_name"))
    resources = base.select(F.col("id").alias("productivity_base"), "resource_name")
    joined = (
        per_user_resource.join(accounts, "system_user")
        .join(departments, "working_department")
        .join(resources, "productivity_base")
        .withColumn("adjusted_productivity_type", type_label(ptype))
    )
    names = ["department_name", "username", "position", "resource_name"]
    return joined.groupBy(
        *[name_key(F.col(n), compare).alias(f"_{n}") for n in names], "adjusted_productivity_type"
    ).agg(
        *[F.min(n).alias(n) for n in names], *[F.sum(s).alias(s) for s in sums]
    ).select(*names, "adjusted_productivity_type", *sums)


def detail_date_mismatch(detail: DataFrame, daily: DataFrame) -> DataFrame:
    """Detail rows whose date is not their parent day's (none: the department
    report may bound its detail scan by date). Rows without a parent day or
    with a NULL date on either side are listed as well."""
    parents = daily.select(F.col("oid").alias("user_productivity_daily"), F.col("date").alias("parent_date"),
                           F.lit(True).alias("_parent"))
    days = detail.groupBy("user_productivity_daily", "date").agg(F.count(F.lit(1)).alias("detail_rows"))
    return (
        days.join(parents, "user_productivity_daily", "left")
        .where(F.col("_parent").isNull() | F.coalesce(F.col("date") != F.col("parent_date"), F.lit(True)))
        .select("user_productivity_daily", "date", "parent_date", "detail_rows")
    )
