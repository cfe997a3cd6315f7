"""Summaries of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper ends of the classes of coverage, and of identity, in percent.
COVERAGE_CLASSES = (20.99, 40.99, 60.99, 80.99, 100.0)
IDENTITY_CLASSES = (30.99, 50.99, 70.99, 90.99, 100.0)


def describe(rows: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """variable, mean, min, median, max of numeric columns; nulls are left out; a column without numbers has nulls."""
    named = [(c, f"avg({c})", f"min({c})", f"percentile({c}, 0.5)", f"max({c})") for c in columns]
    one = rows.agg(*[F.array(*[F.round(F.expr(x).cast("double"), digits) for x in parts]).alias(c) for c, *parts in named])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in columns])).alias("e")
    return one.select(each).select("e.variable", *[F.col("e.v")[i].alias(n) for i, n in enumerate(("mean", "min", "median", "max"))])


def histogram(values: DataFrame, value: str, ends: tuple[float, ...]) -> DataFrame:
    """class_no (from 1), class_end, n: how many values, rounded to two digits, fall into each class.

    Classes without values are listed with 0. Nulls and values above the last end belong to class 0 (class_end null)
    if there are any.
    """
    rounded = F.bround(value, 2)
    number = F.lit(0)
    for i, end in reversed(list(enumerate(ends, 1))):
        number = F.when(rounded <= end, i).otherwise(number)
    counted = values.groupBy(number.alias("class_no")).agg(F.count("*").alias("n"))
    classes = values.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(ends, 1)], "class_no int, class_end double")
    return classes.join(counted, "class_no", "full").select("class_no", "class_end", F.coalesce("n", F.lit(0)).alias("n"))
