"""The two input tables: schemas, readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..operators.columns import drop_range

# One row per person and observation episode. Episode orders a person's rows and is unique
# within the person; DoB and DoD do not change between a person's rows.
EPISODES = T.StructType(
    [
        T.StructField("IndividualId", T.LongType(), False),
        T.StructField("DoB", T.DateType(), False),
        T.StructField("DoD", T.DateType()),
        T.StructField("Sex", T.IntegerType(), False),
        T.StructField("MotherId", T.LongType()),
        T.StructField("Episode", T.LongType(), False),
        T.StructField("StartDate", T.DateType(), False),
        T.StructField("EndDate", T.DateType(), False),
        T.StructField("HouseholdId", T.LongType(), False),
        T.StructField("HHRelation", T.IntegerType(), False),
        T.StructField("Education", T.IntegerType()),
        T.StructField("EducationObsDate", T.DateType()),
        T.StructField("MaritalStatus", T.IntegerType()),
        T.StructField("CurrentlyEmployed", T.IntegerType()),
        T.StructField("NonResident", T.IntegerType(), False),
    ]
)

# One row per pregnancy.
PREGNANCIES = T.StructType(
    [
        T.StructField("PregnancyId", T.LongType(), False),
        T.StructField("WomanId", T.LongType(), False),
        T.StructField("MotherDoB", T.DateType(), False),
        T.StructField("DDate", T.DateType(), False),
        T.StructField("MotherAge", T.IntegerType(), False),
        T.StructField("Outcome", T.StringType(), False),
        T.StructField("LCnt", T.IntegerType(), False),
        T.StructField("BirthOrder", T.IntegerType(), False),
        T.StructField("FirstRecordedDate", T.DateType(), False),
    ]
)

FORMATS = ("parquet", "orc", "csv", "json")


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns, in order and type; a missing one is an error at planning time."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    given = dict(df.dtypes)

    def typed(f: T.StructField) -> Column:
        # text that is no value of the type (NA, for one) is null
        cast = F.col(f.name).try_cast if given[f.name] == "string" else F.col(f.name).cast
        return cast(f.dataType).alias(f.name)

    return df.select(*[typed(f) for f in schema])


def _scan(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    if fmt == "json":
        # no inference pass over the data: the declared columns are all that is read
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def drop_unused(
    df: DataFrame,
    names: Sequence[str] = tuple(fv.EPISODE_DROP_NAMES),
    ranges: Sequence[tuple[str, str]] = tuple(fv.EPISODE_DROP_RANGES),
) -> DataFrame:
    """Drop columns by name and by first:last position; what is not there is passed over."""
    for first, last in ranges:
        if first in df.columns and last in df.columns:
            df = drop_range(df, first, last)
    return df.drop(*names)


def read_episodes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _conform(drop_unused(_scan(spark, path, fmt, EPISODES)), EPISODES)


def read_pregnancies(
    spark: SparkSession, path: str, before: str = fv.DELIVERIES_BEFORE, fmt: str = "parquet"
) -> DataFrame:
    scanned = _scan(spark, path, fmt, PREGNANCIES)
    return delivered_before(_conform(scanned, PREGNANCIES), before)


def delivered_before(pregnancies: DataFrame, before: str = fv.DELIVERIES_BEFORE) -> DataFrame:
    return pregnancies.filter(F.col("DDate") < F.to_date(F.lit(before)))


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_person_table(df: DataFrame, table: str, key: str = "IndividualId", buckets: int = 200) -> None:
    """Save bucketed on the person key: later joins and sums on that key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Save the rows of a report table: a few dozen aggregated rows, so one file."""
    write_frame(df.repartition(1), path, fmt)
