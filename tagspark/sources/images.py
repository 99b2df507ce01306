"""Items in a folder tree."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.images import base64_text, media_type
from tagspark.functions.paths import tags_from_name
from tagspark.functions.text import basename
from tagspark.session import written
from tagspark.sources.memory_table import MemoryTable

# This module travels to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Files or folders that are named to the reader one by one; of more of them a folder above is read.
NAMED = 10_000
MANIFEST = "key string, length bigint, modified timestamp, asked string, request string, created timestamp"


def _is_image(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)\z", 1))
    return ending.isin([f".{e}" for e in fixed.IMAGE_EXTENSIONS])


def image_content(spark: SparkSession, root: str) -> DataFrame:
    """SRC-2: path and bytes of every image under `root`.

    The ending is compared without regard to case, and before a file is
    opened, so that large files of other kinds do no harm. Bytes are only read
    when a later step asks for them.
    """
    letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.{" + ",".join(map(letters, fixed.IMAGE_EXTENSIONS)) + "}").load(root))
    return files.select(_plain(F.col("path")).alias("path"), "content").filter(_is_image(F.col("path")))


def _plain(uri: Column) -> Column:
    return F.regexp_replace(uri, r"\Afile:(//)?", "")


@dataclass(frozen=True)
class ImageFolder:
    """The images under `root`, listed without being opened, and opened only where they are wanted.

    With a `manifest` (a memory table of `MANIFEST` rows, by path) fingerprints of
    files whose length and modification time have not changed are used again.
    """

    spark: SparkSession
    root: str
    manifest: MemoryTable | None = None

    def listing(self) -> DataFrame:
        """SRC-1: path, uri, length, modified of every image; no content is read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        return _few_tasks(files.select(_plain(F.col("path")).alias("path"), F.col("path").alias("uri"), "length",
                                       F.col("modificationTime").alias("modified")).filter(_is_image(F.col("path"))))

    def content(self, wanted: DataFrame) -> DataFrame:
        """SRC-2: path and bytes of the images whose `path` and `uri` are in `wanted`, opening no other files where it can be helped.

        Up to `NAMED` files are read by name; of more of them whole folders are
        read, or all of `root`.
        """
        wanted = written(wanted.select("path", "uri"), "wanted-images")
        read = self.spark.read.format("binaryFile")
        some = [r.uri for r in wanted.select("uri").distinct().limit(NAMED + 1).collect()]
        if not some:
            return self.spark.createDataFrame([], "path string, content binary")
        if len(some) <= NAMED:
            # A name may hold what the reader takes for a pattern.
            files = read.load([_literal(u) for u in some])
            return files.select(_plain(F.col("path")).alias("path"), "content")
        parents = [r.p for r in wanted.select(F.regexp_replace("uri", r"/[^/]*\z", "").alias("p")).distinct().limit(NAMED + 1).collect()]
        files = (read.load([_literal(p) for p in parents]) if len(parents) <= NAMED
                 else read.option("recursiveFileLookup", True).load(self.root))
        return files.select(_plain(F.col("path")).alias("path"), "content").join(wanted.select("path"), "path", "left_semi")

    def fingerprints(self, listed: DataFrame, request: Callable[[DataFrame], Column]) -> DataFrame:
        """S-15: path and `request` (the fingerprint) of the files `listed` (path, uri, length, modified, asked, and what `request` reads).

        `asked` names everything but the content that a fingerprint depends on.
        `request` is given the listed rows with their `content`. Only files
        that the manifest does not know as they are now are opened; their rows are put into it.
        """
        listed = written(listed, "listed-images")
        if self.manifest is None:
            known = self.spark.createDataFrame([], MANIFEST)
        else:
            known = written(self.manifest.matching(listed.select(F.col("path").alias("key"))), "known-images")
        known = known.select(F.col("key").alias("path"), "length", "modified", "asked", "request")
        same = ["path", "length", "modified", "asked"]
        fresh = written(listed.join(known, same, "left_anti"), "fresh-images")
        rows = fresh.join(self.content(fresh), "path")
        hashed = written(rows.select(*same, request(rows).alias("request")), "hashed-images")
        if self.manifest is not None:
            self.manifest.put(hashed.select(F.col("path").alias("key"), "length", "modified", "asked", "request",
                                            F.current_timestamp().alias("created")))
        return listed.join(known, same).select("path", "request").unionByName(hashed.select("path", "request"))


def _literal(uri: str) -> str:
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in uri)


def write_files(files: DataFrame, root: str) -> None:
    """Every row of `files` (name, content) as one file `root`/name, written by the task that holds the row.

    Names are unique and may hold folders. `root` is a folder that all executors share, in a store that Arrow
    reaches. A file gets its name when it is whole, so a task that runs twice does no harm.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        waiting = f"{top}-parts/{uuid.uuid4().hex}"
        store.create_dir(waiting)
        made = set()
        for rows in batches:
            for name, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                folder = f"{top}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{waiting}/file") as out:
                    out.write(content)
                store.move(f"{waiting}/file", f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64())], ["files"])
        store.delete_dir(waiting)

    # Dealt out by number, as a task's time goes with its files and not with their bytes.
    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    files.select("name", "content").repartition(tasks, "name").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def _few_tasks(named: DataFrame) -> DataFrame:
    """Rows that name files and hold none of their bytes, in at most four tasks a core.

    The reader counts every file as at least 4 MB, so a folder of small ones makes a task of 32.
    """
    return named.coalesce(4 * named.sparkSession.sparkContext.defaultParallelism)


def list_images(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """SRC-1, SL-1: paths of every image under `root`, sorted; no limit when 0 or None."""
    paths = _few_tasks(image_content(spark, root).select("path")).orderBy("path")
    return paths.limit(limit) if limit else paths


def labelled_images(spark: SparkSession, root: str, sample: int | None = None) -> DataFrame:
    """SRC-4, SL-2: images whose name is a tag list, with those tags as `truth`."""
    rows = (_few_tasks(image_content(spark, root).select("path")).select("path", tags_from_name(F.col("path")).alias("truth"))
            .filter(F.size("truth") > 0).orderBy("path"))
    return rows.limit(sample) if sample else rows


def encoded_images(spark: SparkSession, root: str) -> DataFrame:
    """SRC-2, S-13, S-14: path, media type by content, and base64 text."""
    return image_content(spark, root).select(
        "path", media_type(F.col("content")).alias("media_type"),
        base64_text(F.col("content")).alias("content_b64"))
