"""Small helpers that several operators of this package share.

Column names. An operator reads the input columns its caller names, keeps every input column and
adds result columns. A result column takes the place of an input column with the same name
(names compare without case, as in Spark). Columns an operator needs on the way get names that
clash with nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINTS = "spark.checkpoint.dir"
#: Parts into which a group is cut for ranks and running sums: about one for each million rows of the table.
PARTS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like the given ones that are not among ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: Iterable[str], *names: str) -> list[str]:
    """The columns but those that have one of the names."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder.

    The session names the checkpoint folder; where it names none, the warehouse (also shared by
    all executors) holds it.
    """
    folder = spark.conf.get(CHECKPOINTS, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{folder}/llm-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written there; frames read from it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(spark: SparkSession, value: Any) -> Broadcast:
    """A value of bounded size for all tasks, with the classes of this package that it is made of."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(value: Broadcast) -> Any:
    """The value of :func:`sent`, unpacked; call it once per task."""
    return cloudpickle.loads(value.value)


def row_hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """A 64-bit hash of a row's columns; null and empty differ."""
    kinds = dict(df.dtypes)
    parts = [F.col(f"`{c}`") if "map<" not in kinds[c] and kinds[c] != "variant" else F.to_json(F.col(f"`{c}`")) for c in columns]
    nulls = [p.isNull() for p in parts]
    return F.xxhash64(F.lit(seed), *parts, *nulls)


def unit_interval(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def running(
    df: DataFrame, group: str | None, place: Column, order: Sequence[Column], amount: Column, upto: str, total: str,
    parts: int = PARTS,
) -> DataFrame:
    """Add ``upto``, the running sum of ``amount`` with the row's own, and ``total``, its group's sum.

    Rows of a group (no nulls in its column; None: one group) stand in the order of (``place``,
    ``order``), where ``place`` is spread evenly over [0, 1). No group meets in one task: it is cut
    into ``parts`` parts by ``place``, the sums of the parts are added up first, and rows are
    ordered within their part only.
    """
    part, before, value = fresh(df.columns, "part", "before", "value")
    by = [group] if group else []
    rows = df.withColumns({part: F.least(F.floor(place * parts).cast("int"), F.lit(parts - 1)), value: amount})
    sums = rows.groupBy(*by, part).agg(F.sum(value).alias(before))
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by, part,
        (F.sum(before).over(whole.orderBy(part)) - F.col(before)).alias(before),
        F.sum(before).over(whole).alias(total),
    )
    within = Window.partitionBy(*by, part).orderBy(place, *order).rowsBetween(Window.unboundedPreceding, 0)
    keep = without(df.columns, upto, total)
    joined = rows.select(*[f"`{c}`" for c in keep], part, value).join(offsets, [*by, part])
    return joined.withColumn(upto, F.col(before) + F.sum(value).over(within)).drop(part, before, value)
