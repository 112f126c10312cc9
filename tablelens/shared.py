"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table there, never by ``localCheckpoint``: the
files survive the loss of any executor, and Parquet lets later stages read
only the columns they need.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    ``spark.checkpoint.dir`` names it. Where that is unset, a folder of this
    machine is used in local mode only; on a cluster that would lose data, so
    it is an error there.
    """
    found = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getConf().get(_DIR_KEY)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{_DIR_KEY} must name a folder shared by all executors")
    made = "file://" + tempfile.mkdtemp(prefix="tablelens-")
    _delete_on_exit(spark, made)
    spark.conf.set(_DIR_KEY, made)
    return made


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exact(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of df, matched by exact spelling, so that further
    columns never clash with what an operator adds, whatever their names are."""
    have = df.columns
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(have)}")
    if len({c.lower() for c in have}) == len(have):
        return df.select(*(F.col(f"`{n}`") for n in names))
    numbered = df.toDF(*(f"c{i}" for i in range(len(have))))
    return numbered.select(*(F.col(f"c{have.index(n)}").alias(n) for n in names))


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """What is run within hands Python batches of at most about so many bytes, so that rows
    of any size don't add up to more than a task holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for an intermediate table, deleted when the session ends."""
    path = f"{shared_dir(spark)}/tablelens/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder; returns it read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write_shared(df, name)[0]


def ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(df written in ranges of an order, which _part numbers; rows of each range). Rows
    that the order doesn't tell apart share a range, so it should end in a key."""
    whole = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    return whole, whole.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's number, from 1, in a total order. No task sorts more than one
    range of it: rows are numbered within ranges, behind the sizes of those before,
    of which there are as many as shuffle partitions."""
    whole, sizes = ranged(df, order)
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return whole.withColumn(name, within).join(bases, F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_p", "_base")


def with_previous(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before in its group (null is a group too), by order.
    Ranges as in with_position, so that neither a large group nor many equal numbers
    are sorted by one task; the last row of a range goes before the first of the next."""
    columns = [group, *order]
    whole, _ = ranged(df, [F.col(c) for c in columns])
    # of a range the last row, then of all ranges before: empty ranges have none
    last = whole.groupBy(F.col("_part").alias("_p")).agg(F.max(F.struct(*columns, F.col(value).alias("_v"))).alias("_last"))
    before = last.select("_p", F.lag("_last").over(Window.orderBy("_p")).alias("_last"))
    within = Window.partitionBy("_part").orderBy(*columns)
    local = whole.withColumns({"_row": F.row_number().over(within), "_lag": F.lag(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).over(within)})
    joined = local.join(before, F.col("_part") == F.col("_p"))
    own = F.when(F.col("_lag.g").eqNullSafe(F.col(group)), F.col("_lag.v"))
    edge = F.when(F.col("_last").isNotNull() & F.col(f"_last.{group}").eqNullSafe(F.col(group)), F.col("_last._v"))
    return joined.withColumn(name, F.when(F.col("_row") > 1, own).otherwise(edge)).drop("_part", "_p", "_row", "_lag", "_last")


def stored_once(df: DataFrame, name: str, *by: str) -> str:
    """The folder of df written partitioned by columns, for as long as the session
    lasts: written at the first call of that name for the files that df reads, in
    their present state. Partitions with many rows are written by several tasks."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for file in sorted(df.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(file)
        status = at.getFileSystem(conf).getFileStatus(at)
        state.append((file, status.getLen(), status.getModificationTime()))
    key = hashlib.sha256(repr((spark.sparkContext.applicationId, name, by, df.schema.json(), state)).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/tablelens/{name}-{key}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        df.hint("rebalance", *(F.col(f"`{c}`") for c in by)).write.mode("overwrite").partitionBy(*by).parquet(path)
        _delete_on_exit(spark, path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session's executors, once,
    through the shared folder. An installed copy is not needed there then."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    code = io.BytesIO()
    with zipfile.ZipFile(code, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, Path(package.name) / source.relative_to(package))
    jvm = sc._jvm
    target = f"{shared_dir(spark)}/tablelens/code-{uuid.uuid4().hex}/tablelens.zip"
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(code.getvalue())
    out.close()
    _delete_on_exit(spark, target)
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
