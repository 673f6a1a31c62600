"""What a query's physical plan contains."""

from __future__ import annotations


def plan_text(df, run: bool = False) -> str:
    if run:
        df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def optimized_text(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
