"""Tables with a log of versions on a shared file system: safe switches, pinned readers, bucketed merges (SNK7, SNK11, SRC16, SRC17, STM5, STM6).

A version is one small file of the log, named by its number: which folders hold the table's buckets, and which micro-batches
are in it. Data are written first, checked, and only then is the next number taken. Taking it is a rename that fails
where the name exists, so of two writers one wins and the other starts again. What was there stays as it was, and a
reader keeps to its version.

The rename is one step on file systems like HDFS; on a local disk Hadoop looks and then renames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = "all"
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer took the version."""


class Unhealthy(ValueError):
    """New data failed their check; the table is as it was."""


class Versions:
    """The log of one table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.conf)

    def latest(self) -> int:
        """The last version, 0 if there is none."""
        log = self._at("log")
        if not self._fs().exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What the log says of a version (the last one by default)."""
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "parts": {}, "batches": {}, "schema": None, "buckets": None}
        stream = self._fs().open(self._at(f"log/{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table at a version, or some of its buckets only: other folders aren't opened."""
        entry = self.entry(version)
        if entry["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version")
        schema = T.StructType.fromJson(entry["schema"])
        parts = entry["parts"] if buckets is None else {k: p for k, p in entry["parts"].items() if int(k) in set(buckets)}
        folders = sorted(f"{self.path}/{p}" for p in parts.values())
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, check: Callable[[DataFrame], bool] | None = None, parent: int | None = None, buckets: int | None = None, keys: list[str] | None = None) -> int:
        """df as the next version (SNK11); with buckets, dealt by a hash of `keys`. Returns the version's number.

        The new data are read back and given to `check` before the switch. Unhealthy: they go, and the old version stays.
        parent: the version that df was made from; Conflict if another one came meanwhile.
        """
        parent = self.latest() if parent is None else parent
        name = f"data/{uuid.uuid4().hex}"
        if buckets is None:
            df.write.parquet(f"{self.path}/{name}")
            parts, schema = {WHOLE: name}, df.schema
        else:
            parts, schema = self._buckets(df, name, buckets, keys), df.schema
        return self._commit(parent, {"parts": parts, "batches": {}, "schema": json.loads(schema.json()), "buckets": buckets, "keys": keys}, name, check)

    def merge(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], batch: int, stream: str = "stream", check: Callable[[DataFrame], bool] | None = None) -> int:
        """A micro-batch merged in: merged(old rows, new rows) of the buckets that it touches, the others stay as they are.

        A batch whose number the table has already for its stream changes nothing, so batches may be given again. merged() must
        keep rows in the bucket of their keys. Returns the version's number (the old one if nothing changed).
        """
        old = self.entry()
        if old["buckets"] is None:
            raise ValueError("only bucketed tables take merges")
        if batch <= old["batches"].get(stream, -1):
            return old["version"]
        dealt = self._dealt(rows, old["buckets"], old["keys"])
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # at most one number for each bucket
        name = f"data/{uuid.uuid4().hex}"
        new = merged(self.read(old["version"], touched), rows)
        parts = old["parts"] | self._buckets(new, name, old["buckets"], old["keys"])
        entry = {k: old[k] for k in ("schema", "buckets", "keys")} | {"parts": parts, "batches": old["batches"] | {stream: batch}}
        return self._commit(old["version"], entry, name, check)

    def remove_unused(self, keep: int = 1) -> int:
        """Deletes data folders that none of the last `keep` versions names, and returns how many; older versions can't be read then."""
        last = self.latest()
        used = {p.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for p in self.entry(v)["parts"].values()}
        gone = [s.getPath() for s in self._fs().listStatus(self._at("data")) if s.getPath().getName() not in used]
        for path in gone:
            self._fs().delete(path, True)
        return len(gone)

    def _dealt(self, df: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def _buckets(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> dict[str, str]:
        self._dealt(df, buckets, keys).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._fs().listStatus(self._at(name)) if s.isDirectory()]
        return {f.split("=")[1]: f"{name}/{f}" for f in found if f.startswith(f"{BUCKET}=")}

    def _commit(self, parent: int, entry: dict, name: str, check: Callable[[DataFrame], bool] | None) -> int:
        entry |= {"version": parent + 1, "parent": parent}
        if check is not None:
            new = self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*sorted(f"{self.path}/{p}" for p in entry["parts"].values())) if entry["parts"] else self.spark.createDataFrame([], T.StructType.fromJson(entry["schema"]))
            if not check(new):
                self._fs().delete(self._at(name), True)
                raise Unhealthy(f"{self.path}: version {parent + 1} failed its check")
        self._fs().mkdirs(self._at("log"))
        draft = self._at(f"log/.{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.conf)
        try:
            context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(self._at(f"log/{parent + 1:012d}.json")), how)
        except Exception as e:
            self._fs().delete(draft, False)
            if not self._fs().exists(self._at(f"log/{parent + 1:012d}.json")):
                raise
            self._fs().delete(self._at(name), True)
            raise Conflict(f"{self.path}: version {parent + 1} is there already") from e
        return parent + 1


def first_of(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, such as a question set and its fallback (SRC17); FileNotFoundError if none does."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return path
    raise FileNotFoundError(", ".join(paths))


class JsonCache:
    """JSON data sets that are read once for each modification time of their path (SRC16)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held, self.loads = spark, {}, 0

    def read(self, path: str, schema: str) -> DataFrame:
        """The data set as it is now; held in memory by executors, and released once the path has changed."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        state = files.getFileStatus(where)
        stamp = tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in files.listStatus(where))) if state.isDirectory() else (state.getModificationTime(), state.getLen())
        had = self.held.get(path)
        if had is None or had[0] != stamp:
            if had is not None:
                had[1].unpersist()
            self.loads += 1
            self.held[path] = had = stamp, self.spark.read.schema(schema).option("multiLine", "true").json(path).persist()
        return had[1]
