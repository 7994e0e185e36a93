"""What the training-data operators share: safe column picking, shared tables, distributed numbering."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import importable, shared_top

_WRITTEN: list = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns, as new=old; other columns go.

    Columns are found by position first, so names that differ in case only, or that clash with names used
    inside an operator, do no harm. A name that is missing in exact case raises ValueError.
    """
    importable(df.sparkSession)
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    if missing := [c for c in columns.values() if c not in at]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    plain = df.toDF(*[f"_p{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_p{at[old]}").alias(new) for new, old in columns.items()])


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns _d0, _d1 .., and which of them each (exact, first) name became; undone by toDF(*df.columns).

    So joins and new columns can't clash with whatever else a table holds.
    """
    at: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, f"_d{i}")
    return df.toDF(*[f"_d{i}" for i in range(len(df.columns))]), at


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share."""
    return f"{shared_top(spark)}/lodestone-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def _files_freed(spark: SparkSession):
    """Meanwhile Spark deletes a statement's shuffle files once it has ended; what was written needs them no more."""
    had = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, had) if had is not None else spark.conf.unset(_FREE)


@contextlib.contextmanager
def few_large_tasks(spark: SparkSession):
    """Meanwhile Python workers get batches of at most 4 MB (a large row comes alone; the default is 64 MB), and adaptive
    execution makes partitions of 64 MB, its default, so that tables of large rows aren't written as very many files. Parquet is
    read 32 rows at a time (the default, 4,096, is a whole file of rows of 240 KB, held in arrays that double as they grow),
    and written in row groups of 8 MB or 100 rows, not 128 MB, which a writer holds until they are full."""
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.parquet.columnarReaderBatchSize": "32",
        "parquet.block.size": str(8 << 20),
    }
    had = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in had.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends here, and lost executors cost nothing.

    The table lives until Python ends, or until drop_staged().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    # Names that differ in case only can't be written, so then columns are numbered in the files.
    names = df.columns
    alike = len({n.lower() for n in names}) < len(names)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))]) if alike else df
    with _files_freed(spark):
        plain.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(plain.schema).parquet(path)
    out = out.toDF(*names) if alike else out
    out._lodestone_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_lodestone_path", None)
        if path is not None:
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    # A stopped session has no settings any more, but its JVM can still delete.
    conf = jvm.org.apache.hadoop.conf.Configuration() if context is None else context.hadoopConfiguration()
    where.getFileSystem(conf).delete(where, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@atexit.register
def _clean() -> None:
    # What fails here, such as a JVM that has ended, must not turn a finished program into a failed one.
    for spark, path in list(_WRITTEN):
        with contextlib.suppress(Exception):
            _remove(spark, path)


def buckets_for(rows: int, least: int = 64, rows_each: int = 200_000, most: int = 65_536) -> int:
    """How many parts a hot key is dealt into when its rows are numbered."""
    return max(least, min(most, -(-rows // rows_each)))


def numbered(df: DataFrame, key: str, spread: Column, order: list[Column], name: str, parts: int) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... within each key, without ever gathering a key in one task.

    Rows of a key are dealt into `parts` parts by the hash of `spread`; parts are numbered on their own, and
    each starts where the counts of the parts before it end. The counts are a table of at most keys x parts rows,
    joined (not collected). Call it on a staged table: it is read twice.
    """
    spark = df.sparkSession
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.select(F.col(key).alias("_key"), F.col("_part").alias("_kpart"), "_start")
    within = Window.partitionBy(key, "_part").orderBy(*order)
    ranked = dealt.withColumn("_rn", F.row_number().over(within) - 1)
    joined = ranked.join(starts, ranked[key].eqNullSafe(starts["_key"]) & (ranked["_part"] == starts["_kpart"]), "left")
    out = joined.withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
    assert spark is out.sparkSession
    return out.drop("_part", "_key", "_kpart", "_start", "_rn")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
