"""What a candidate would archive, and why everything else stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.selection import Tables, daily_totals, root_predicate, select_candidate
from tideline.plans.group import GroupPlan


def root_counts(plan: GroupPlan, root: DataFrame) -> DataFrame:
    """Undated, dated and eligible root rows in one pass."""
    column = F.col(plan.spec.date_column)
    return root.agg(
        F.count_if(column.isNull()).alias("null_rows"),
        F.count_if(column.isNotNull()).alias("dated_rows"),
        F.count_if(root_predicate(plan, root, plan.spec.cutoff_day)).alias("eligible_root_rows"),
    )


def preview_exclusions(plan: GroupPlan, tables: Tables, days: DataFrame | None = None) -> DataFrame:
    """Rows per reason for staying out.

    ``null_date`` and ``protected_period`` count root rows; ``after_boundary`` and ``target_not_reached``
    count rows of the whole group. Only one of the last two can appear.
    """
    days = daily_totals(plan, tables) if days is None else days
    reached = F.col("reached_target")

    def line(reason: str, n: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), n.alias("n"))

    root_lines = root_counts(plan, tables[plan.spec.root]).select(
        F.inline(
            F.array(
                line("null_date", F.col("null_rows")),
                line("protected_period", F.col("dated_rows") - F.col("eligible_root_rows")),
            )
        )
    )
    group_lines = select_candidate(days, plan.spec.target).select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(reached, line("after_boundary", F.col("eligible_total") - F.col("total_selected"))),
                    F.when(
                        ~reached & (F.col("eligible_total") > 0), line("target_not_reached", F.col("eligible_total"))
                    ),
                )
            )
        )
    )
    return root_lines.unionByName(group_lines)


def candidate_status(selection: DataFrame, blocked: Column | bool = False) -> DataFrame:
    """blocked, no_eligible_rows, ready or target_not_reached."""
    blocked = F.lit(blocked) if isinstance(blocked, bool) else blocked
    return selection.withColumn(
        "status",
        F.when(blocked, "blocked")
        .when(F.col("eligible_total") == 0, "no_eligible_rows")
        .when(F.col("reached_target"), "ready")
        .otherwise("target_not_reached"),
    )
