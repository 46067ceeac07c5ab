"""Data-quality checks; each returns violation rows (Q01-Q05)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Class number format, metric types, smallest intervals in seconds.
DEWEY_FORMAT = r"^\d{3}(\.\d{1,2})?$"
METRIC_TYPES = ["gauge", "counter", "histogram"]
MIN_INTERVAL_S = 10
MIN_BACKUP_S = 3600


def check_required(df: DataFrame, key: str, spec: Mapping[str, str]) -> DataFrame:
    """Q01: a required field that is NULL, or whose text is not of its type."""
    problems, types = [], dict(df.dtypes)
    for field, dtype in spec.items():
        value = F.col(field)
        parsed = value.try_cast(dtype)
        if types[field] == "string" and dtype in ("int", "bigint", "long"):
            # A cheap look first: a failing cast costs far more than a pattern test.
            parsed = F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), parsed)
        bad_type = F.lit(False) if types[field] == dtype else value.isNotNull() & parsed.isNull()
        problem = F.when(value.isNull(), "missing").when(bad_type, "type")
        problems.append(F.when(problem.isNotNull(),
                               F.struct(F.lit(field).alias("field"), problem.alias("problem"))))
    return df.select(key, F.inline(F.array_compact(F.array(*problems))))


def check_dewey(df: DataFrame, key: str, col: str = "dewey_decimal") -> DataFrame:
    """Q02."""
    return df.filter(~F.coalesce(F.col(col).rlike(DEWEY_FORMAT), F.lit(False))).select(key, col)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q03: key values that occur more than once; counting combines before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def check_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Q04: child rows whose key has no parent."""
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")


def check_defs(defs: DataFrame, sections: Sequence[str] = ()) -> DataFrame:
    """Q05: unknown type, short interval, duplicate name, missing section as (collector, name, problem)."""
    bad_type = F.when(~F.col("type").isin(METRIC_TYPES), "type")
    bad_interval = F.when(F.col("interval_s") < MIN_INTERVAL_S, "interval")
    rows = defs.select("collector", "name",
                       F.explode(F.array_compact(F.array(bad_type, bad_interval))).alias("problem"))
    twice = (check_unique(defs, ["name"])
             .select(F.lit(None).cast("string").alias("collector"), "name",
                     F.lit("duplicate").alias("problem")))
    out = rows.unionByName(twice)
    if sections:
        wanted = defs.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(s) for s in sections])).alias("collector"))
        absent = wanted.join(defs.select("collector"), "collector", "left_anti").select(
            "collector", F.lit(None).cast("string").alias("name"), F.lit("section").alias("problem"))
        out = out.unionByName(absent)
    return out


def check_backup_interval(settings: DataFrame) -> DataFrame:
    """Q05: backup intervals below an hour."""
    return settings.filter(F.col("backup_interval") < MIN_BACKUP_S)
