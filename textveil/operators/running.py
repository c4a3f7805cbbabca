"""Sums, order statistics and rolling medians along an order, where one key may hold most of the rows.

Rows are dealt by ranges of key and order, and a range counts on from the sums of those before it:
of a key only one row a range meets in one task, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .vault import _held

#: Rows of one block of a rolling window, as a multiple of the window.
BLOCK = 16


def _same(keys: list[str], left: str = "", right: str = "__of_") -> Column:
    """Null-safe equality of the keys on both sides of a join."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}"))
    return out


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum over the rows of its key that come before it (0 for the first).

    Null keys are one key.  Rows that tie in ``order`` stand in one range, in any order among themselves.
    """
    cells = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    dealt = _held(cells.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__part").alias("__of_part"), *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({f"__i_{n}": F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0)) for n in sums})
    out = inner.join(before, _same(keys) & (F.col("__part") == F.col("__of_part")))
    return out.select(*[c for c in df.columns if c not in sums], *[(F.col(f"__i_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def order_statistics(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """Per key: n, least, median, upper_median, most, and each of ``fractions`` by nearest rank, all exact.

    The rank of a fraction is ``fraction * (n - 1)``, halves to the even one; ``upper_median`` has rank n // 2.
    Equal values are counted before they travel, and ranks are read from running counts, so no key is sorted
    in one task.  Null and NaN values are left out; a key without others has no row.
    """
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = kept.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = running(counts, keys, [value], {"__before": F.col("__n")})
    ends = ranked.groupBy(*keys).agg(F.sum("__n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    n = F.col("n")
    ranks = {"__low": F.floor((n - 1) / 2), "upper_median": F.floor(n / 2)} | {k: F.bround(F.lit(f) * (n - 1)) for k, f in (fractions or {}).items()}
    wanted = ends.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "n", "least", "most", *[r.cast("bigint").alias(f"__r_{k}") for k, r in ranks.items()])
    met = ranked.join(wanted, _same(keys))
    pick = lambda k: F.max(F.when((F.col("__before") <= F.col(f"__r_{k}")) & (F.col(f"__r_{k}") < F.col("__before") + F.col("__n")), F.col(value))).alias(k)
    out = met.groupBy(*keys).agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"), *[pick(k) for k in ranks])
    return out.withColumn("median", (F.col("__low") + F.col("upper_median")) / 2).drop("__low")


def rolling_median(df: DataFrame, order: list[str], value: str, window: int = 1024, keys: Iterable[str] = (), name: str = "p50") -> DataFrame:
    """``df`` with the median of the last ``window`` values of its key, its own included, along ``order``.

    Rows are numbered by ``running`` and cut into blocks; a block also gets the ``window - 1`` rows before it.
    Rows with null or NaN values are no measurement and are left out; fewer values than a window have their own median.
    """
    keys = list(keys)
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    size = BLOCK * window
    placed = running(kept, keys, order, {"__at": F.lit(1).cast("bigint")})
    own = F.floor(F.col("__at") / size)
    blocks = F.when(F.col("__at") % size > size - window, F.array(own, own + 1)).otherwise(F.array(own))
    sent = placed.withColumn("__block", F.explode(blocks))
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def slide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at")
        rows[name] = rows[value].astype("float64").rolling(window, min_periods=1).median()
        return rows[rows["__at"] // size == rows["__block"]][schema.names]

    return sent.groupBy(*keys, "__block").applyInPandas(slide, schema)
