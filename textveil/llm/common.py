"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset in local mode (tests), a new one is set.

    A cluster names a folder there that driver and executors share.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textveil-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, free: bool = True) -> DataFrame:
    """``df`` computed once and held in the checkpoint folder, with no lineage before it."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if free:
        free_shuffles(df.sparkSession)
    return out


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: columns can be pruned."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage, on which Spark deletes shuffle files of plans that have ended.

    A driver with little to do rarely collects by itself, and the files of all earlier stages stay;
    the heap that it would otherwise take between two collections stays small as well.
    """
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to ``rows`` rows for what is planned and run inside: for rows that carry whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that are of no more use."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever they are called, play no part."""
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


#: Rows of a slim table (ids and a few numbers, some 50 bytes a row) up to which it is broadcast.
SLIM_ROWS = 200_000


def row_count(df: DataFrame) -> int:
    """Rows of ``df``, counted in its tasks and added up by the driver.

    ``count()`` is a query with an exchange: on the driver each exchange and each adaptive query
    starts a thread that stays for a minute, and the plans of all its updates make garbage.
    """
    return df.select()._jdf.javaRDD().count()


def by_size(rows: int) -> Callable[[DataFrame], DataFrame]:
    """Marks slim tables of up to ``rows`` rows for broadcast, or leaves them to a shuffle."""
    return F.broadcast if rows <= SLIM_ROWS else lambda df: df


def sized(right: DataFrame) -> DataFrame:
    """A table of ids, counted first: marked for broadcast up to ``SLIM_ROWS``, else left to a shuffle."""
    return by_size(row_count(right))(right)


def slim_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return left.join(sized(right), on, how)
