"""The request memory as a versioned table whose files a small batch can skip.

    <path>/data/<version>/bucket=<b>/part-*.parquet     answers whose key falls into bucket b
    <path>/versions/<number>.json                       folder of every bucket in that version

A put merges new answers into the buckets they touch and writes those buckets alone into a new
folder; buckets without news stay where an earlier version left them. The version exists once its
file is there, which one rename brings about, so that a reader sees the version before or the one
after and a lost job leaves nothing but an unused folder. Of two writers the later one finds its
number taken, merges again on top of the other's version and tries the next number.

A probe reads the buckets that its keys fall into. Within a file keys are sorted and have a Bloom
filter, so that a few keys skip row groups as well.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagspark.operators.keyed import last_per_key
from tagspark.sources.stores import MEMORY

# Buckets of a new table. A put or a probe handles a list of at most so many folders.
BUCKETS = 256


class VersionTaken(RuntimeError):
    """Another writer has committed every version this one tried."""


@dataclass(frozen=True)
class Version:
    """One state of the table: its number (0: nothing written yet), the number of buckets, and the folder of each bucket that has rows."""

    number: int
    buckets: int
    folders: dict[int, str]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class MemoryTable:
    """Answers by key. `schema` must have a `key`; of several rows of a key the one with the greatest `created` counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str = MEMORY, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = StructType.fromDDL(schema)

    # Files of a few bytes, read and written on the driver through Spark's own file systems.
    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions there are, oldest first."""
        files = self._files()
        folder = self._at("versions")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number."""
        if number is None:
            number = max(self.versions(), default=0)
            if not number:
                return Version(0, self.buckets, {})
        stream = self._files().open(self._at(f"versions/{number}.json"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, said["buckets"], {int(b): f for b, f in said["folders"].items()})

    def _commit(self, new: Version) -> bool:
        """Make `new` visible unless its number is taken."""
        files, waiting = self._files(), self._at(f"versions/.{uuid.uuid4().hex}")
        out = files.create(waiting, True)
        out.write(bytearray(json.dumps({"buckets": new.buckets, "folders": new.folders}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(waiting), files.makeQualified(self._at(f"versions/{new.number}.json")), options)
        except Exception as exc:
            files.delete(waiting, False)
            if "FileAlreadyExists" in str(exc):
                return False
            raise
        return True

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in sorted(folders)])

    def read(self, number: int | None = None) -> DataFrame:
        """SRC-9: every answer of the newest version, or of the one of that number."""
        return self._read(list(self.version(number).folders.values()))

    def put(self, rows: DataFrame, attempts: int = 5) -> int:
        """SNK-3: insert or replace answers by key; returns the number of the version that holds them.

        The new version's number is one above that of the version merged with.
        Rows without a key are left out. A put without rows makes no version.
        """
        rows = last_per_key(rows.select(*self.schema.names).filter(F.col("key").isNotNull()), ["key"], F.col("created"))
        for _ in range(attempts):
            old = self.version()
            news = rows.withColumn("bucket", bucket_of(F.col("key"), old.buckets))
            touched = sorted(r.bucket for r in news.select("bucket").distinct().collect())
            if not touched:
                return old.number
            merged = news.drop("bucket").unionByName(self._read([old.folders[b] for b in touched if b in old.folders]))
            folder = f"{old.number + 1}-{uuid.uuid4().hex}"
            (last_per_key(merged, ["key"], F.col("created")).withColumn("bucket", bucket_of(F.col("key"), old.buckets))
             .repartition("bucket").sortWithinPartitions("bucket", "key").write
             .option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket").parquet(f"{self.path}/data/{folder}"))
            new = Version(old.number + 1, old.buckets, {**old.folders, **{b: f"{folder}/bucket={b}" for b in touched}})
            if self._commit(new):
                return new.number
        raise VersionTaken(self.path)

    def matching(self, requests: DataFrame, number: int | None = None) -> DataFrame:
        """JN-2: the answers to `requests` (`key`), read from the buckets the keys fall into.

        At most as many bucket numbers as there are buckets reach the driver,
        and the keys themselves only where they are few enough for a scan to
        look them up in the Bloom filters.
        """
        version = self.version(number)
        keys = requests.select("key").filter(F.col("key").isNotNull()).distinct()
        asked = {r.bucket for r in keys.select(bucket_of(F.col("key"), version.buckets).alias("bucket")).distinct().collect()}
        found = self._read([f for b, f in version.folders.items() if b in asked])
        most = int(self.spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
        few = [r.key for r in keys.limit(most + 1).collect()] if len(asked) <= most else []
        if few and len(few) <= most:
            return found.filter(F.col("key").isin(few))
        return found.join(keys, "key", "left_semi")

    def forget(self, keep: int = 2) -> None:
        """Delete all but the newest `keep` versions, and the folders that only they hold.

        For a time without readers of old versions and without writers, as a
        folder that is still being written belongs to no version yet.
        """
        files, numbers = self._files(), self.versions()
        kept = {f.split("/")[0] for n in numbers[-keep:] for f in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            files.delete(self._at(f"versions/{n}.json"), False)
        data = self._at("data")
        for status in files.listStatus(data) if files.exists(data) else []:
            if status.getPath().getName() not in kept:
                files.delete(status.getPath(), True)
