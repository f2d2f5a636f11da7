"""Row filters on outliers, column after column.

Each column's limits come from the rows that passed the previous columns, so
the limits cannot be computed together.  Nothing is cached between columns:
every pass re-reads only the columns met so far, with the earlier limits
pushed down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import number, numeric_columns
from rowmill.functions.quantiles import quantiles
from rowmill.operators.steps import Step, applies


def fit_outliers(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: list[str] | None = None
) -> Step:
    limits: list[list] = []
    step = Step("outliers", {"method": method, "threshold": threshold, "limits": limits})
    if method not in ("iqr", "zscore"):
        return step
    for c in columns or numeric_columns(df):
        left = step.transform(df)
        if method == "iqr":
            q = quantiles(left, {c: [0.25, 0.75]})[c]
            if q[0.25] is None:
                limits.append([c, None, None])
                continue
            reach = threshold * (q[0.75] - q[0.25])
            limits.append([c, q[0.25] - reach, q[0.75] + reach])
        else:
            x = number(left, c)
            mean, std = left.agg(F.avg(x), F.stddev_samp(x)).first()
            limits.append([c, mean, std])
    return step


@applies("outliers")
def _outliers(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    for c, a, b in state["limits"]:
        x = number(df, c)
        if a is None or b is None or (state["method"] == "zscore" and b == 0):
            # No values or no spread: no score is defined and no row passes.
            df = df.filter(F.lit(False))
        elif state["method"] == "iqr":
            df = df.filter((x >= a) & (x <= b))
        else:
            df = df.filter(F.abs(x - a) / b <= state["threshold"])
    return df
