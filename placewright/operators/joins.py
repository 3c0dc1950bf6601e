"""Joins on references that may be unknown, and joins of tables that both grow."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = "_known_key"


def join_dealt(rows: DataFrame, others: DataFrame, on, how="inner") -> DataFrame:
    """Join of two tables that both grow with the input: dealt by the key and merged, never broadcast.

    Files are many times smaller than their rows, so by their size tables of a million rows pass for
    small ones; each broadcast is then held whole by the driver and by every executor.
    """
    return rows.join(others.hint("merge"), on, how)


def join_stored(rows: DataFrame, others: DataFrame, on: str, how="left", dealt=False) -> DataFrame:
    """join_known for rows that are stored, or cheap to make: these are read twice, and the ones whose
    reference is NULL are passed on as they are, not dealt. With `dealt` it is a join_dealt."""
    if how not in ("left", "left_anti"):
        raise ValueError("left or left_anti expected")
    known = rows.where(F.col(on).isNotNull())
    known = join_dealt(known, others, on, how) if dealt else known.join(others, on, how)
    missing = [] if how == "left_anti" else [f for f in others.schema if f.name != on]
    passed = rows.where(F.col(on).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    return known.select(*passed.columns).unionByName(passed)


def join_known(rows: DataFrame, others: DataFrame, on, how="left", dealt=False) -> DataFrame:
    """Left or left_anti join on one column or several, of which any may be NULL in many rows.

    A NULL meets nothing, yet such a join deals all rows by its key, and would send all rows without
    one to a single task. Here they are dealt by their other values. With `dealt` it is a join_dealt.
    """
    if how not in ("left", "left_anti"):
        raise ValueError("left or left_anti expected")
    names = [on] if isinstance(on, str) else list(on)

    def stated():
        texts = [F.col(n).cast("string") for n in names]
        return F.concat(F.lit("="), texts[0] if len(texts) == 1 else F.to_json(F.array(*texts)))

    unknown = F.lit(False)
    for name in names:
        unknown = unknown | F.col(name).isNull()
    plain = [f.name for f in rows.schema if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    other = F.concat(F.lit("~"), F.xxhash64(*plain).cast("string"))
    keyed = rows.withColumn(_KEY, F.when(unknown, other).otherwise(stated()))
    known = others.withColumn(_KEY, F.when(~unknown, stated())).drop(*names)
    return (join_dealt(keyed, known, _KEY, how) if dealt else keyed.join(known, _KEY, how)).drop(_KEY)
