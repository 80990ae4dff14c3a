"""Output conventions of registered queries: bigint counts, text dates, doubles rounded past any noise.

Doubles are nudged by 3e-8 before they are rounded, in Spark and in the SQL alike, so that sums of
decimals that lie on a rounding edge fall on the same side whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 5


def near(sql: str, digits: int = DIGITS) -> str:
    return f"round(({sql}) + 3e-8, {digits})"


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    out = []
    for c, t in df.dtypes:
        if t in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        elif t == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(c))
        elif t in ("double", "float"):
            out.append(F.round(F.col(c).cast("double") + 3e-8, digits.get(c, DIGITS)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def query(queries: dict, oracle: dict[str, str]):
    """A decorator that registers a query under its name, with its SQL if it has any; results are tidied."""

    def with_sql(sql: str | None = None):
        def register(fn):
            def run(spark, d):
                return tidy(fn(spark, d))

            run.__name__, run.__doc__ = fn.__name__, fn.__doc__
            queries[fn.__name__] = run
            if sql:
                oracle[fn.__name__] = sql
            return fn

        return register

    return with_sql
