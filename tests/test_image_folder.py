"""Images listed and opened only where they are wanted, and fingerprints used again."""

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagspark.plans.tagging_job import tag_items
from tagspark.session import written
from tagspark.sources import images
from tagspark.sources.images import MANIFEST, ImageFolder
from tagspark.sources.memory_table import MemoryTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Echo:
    """Answers every image with the tag `widget`."""

    def predict_tags(self, content_b64, media_type, context, examples):
        return ["widget"]


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture
def root(folder):
    for i in range(6):
        put(folder, f"images/shop/kind/{i} [a].jpg", f"image {i}".encode())
    put(folder, "images/notes.txt", b"no image")
    return f"{folder}/images"


@pytest.fixture
def opened(monkeypatch):
    """Names of the files whose content is asked for, run by run."""
    seen = []
    plain = ImageFolder.content
    monkeypatch.setattr(ImageFolder, "content", lambda self, wanted: seen.append(
        sorted(os.path.basename(r.path) for r in wanted.select("path").collect())) or plain(self, wanted))
    return seen


def test_listing_reads_no_content(spark, root):
    listing = ImageFolder(spark, root).listing()
    assert sorted(os.path.basename(r.path) for r in listing.collect()) == [f"{i} [a].jpg" for i in range(6)]
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("named", [100, 3, 0])
def test_content_of_some(spark, root, monkeypatch, named):
    put(root, "other/x.jpg", b"x")
    put(root, "third/y.jpg", b"y")
    monkeypatch.setattr(images, "NAMED", named)
    folder = ImageFolder(spark, root)
    wanted = folder.listing().filter(~F.col("path").contains("third"))
    got = {os.path.basename(r.path): bytes(r.content) for r in folder.content(wanted).collect()}
    assert got == {**{f"{i} [a].jpg": f"image {i}".encode() for i in range(6)}, "x.jpg": b"x"}
    assert folder.content(wanted.limit(0)).collect() == []


def test_a_second_run_of_an_unchanged_folder_opens_nothing(spark, root, folder, opened):
    shop = ImageFolder(spark, root, MemoryTable(spark, f"{folder}/manifest", MANIFEST, buckets=4))
    memory = MemoryTable(spark, f"{folder}/memory", buckets=4)
    options = dict(model_id="m", vocabulary=["widget"], highlight_family=["widget"], memory=memory, passes=1)

    def run(**more):
        opened.clear()
        done = tag_items(shop, Echo, **{**options, **more})
        memory.put(done.memory_rows)
        return {os.path.basename(r.path): (r.tags, r.cached, r.key) for r in done.rows.collect()}

    first = run()
    assert [t for t, *_ in first.values()] == [["widget"]] * 6 and not any(c for _, c, _ in first.values())
    assert opened[0] == sorted(first)
    again = run()
    assert opened == [[], []] and {n: k for n, (*_, k) in again.items()} == {n: k for n, (*_, k) in first.items()}
    assert all(c for _, c, _ in again.values())
    # One file changed and one new: these are hashed and asked about, no other.
    put(root, "shop/kind/0 [a].jpg", b"another image")
    put(root, "shop/kind/7.jpg", b"image 7")
    third = run()
    assert opened == [["0 [a].jpg", "7.jpg"], ["0 [a].jpg", "7.jpg"]]
    assert third["0 [a].jpg"][2] != first["0 [a].jpg"][2] and third["1 [a].jpg"] == again["1 [a].jpg"]
    # Another model asks other questions.
    run(model_id="n")
    assert len(opened[0]) == 7


def test_the_same_keys_as_without_a_manifest(spark, root, folder):
    items = images.image_content(spark, root)
    options = dict(model_id="m", vocabulary=["widget"], highlight_family=["widget"], passes=1)
    empty = MemoryTable(spark, f"{folder}/memory", buckets=4)
    rows = lambda source, memory: sorted((r.path, r.key, r.tags) for r in tag_items(source, Echo, memory=memory, **options).rows.collect())
    assert rows(ImageFolder(spark, root), empty) == rows(items, empty)
    assert rows(ImageFolder(spark, root), None) == rows(items, None)


def test_files_are_written_by_tasks(spark, folder):
    rows = [(f"shop {i % 3}/{i} ['a', 'b'].jpg", f"image {i}\n".encode()) for i in range(50)] + [("top.jpg", b"")]
    images.write_files(spark.createDataFrame(rows, "name string, content binary"), f"file://{folder}/made")
    got = {os.path.relpath(os.path.join(d, n), f"{folder}/made"): open(os.path.join(d, n), "rb").read()
           for d, _, names in os.walk(f"{folder}/made") for n in names}
    assert got == dict(rows) and os.listdir(f"{folder}/made-parts") == []


@pytest.mark.parametrize("query", ["image_payloads", "image_listing", "labelled_sample"])
def test_folder_of_a_query_takes_one_row_to_the_driver(spark, folder, monkeypatch, query):
    from tagspark.catalog import image_queries

    spark.range(40).selectExpr("id AS s_suppkey", "CAST(id % 25 AS int) AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    taken, plain = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: taken.append(rows := plain(self)) or rows)
    result = getattr(image_queries, query)(spark, folder)
    assert max((len(rows) for rows in taken), default=0) <= 1
    assert plain(result)


def test_folder_leaves_no_folder_per_file(spark, folder):
    from tagspark.catalog import image_queries

    spark.range(10).selectExpr("id AS s_suppkey", "CAST(id % 25 AS int) AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    root = image_queries._folder(spark, folder)
    assert os.listdir(f"{root}-parts") == []
    # A second run over what was written: the manifest and the memory hold every file as it is.
    rows = image_queries.tagging_unchanged(spark, folder).collect()
    assert len(rows) == 10 and all(r.cached and r.attempts == 0 for r in rows)


@pytest.fixture
def tasks_of(spark):
    """The most tasks that a stage of an action had, every file being as large as a task may read."""
    def most(action):
        group = f"tasks-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, group)
        action()
        seen = spark.sparkContext.statusTracker()
        stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds]
        return max(s.numTasks for s in stages if s)

    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    yield most
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def many(folder):
    for i in range(60):
        put(folder, f"many/{i % 3}/{i:02} ['red'].jpg", b"x")
    return f"{folder}/many"


def test_images_are_listed_in_few_tasks(spark, many, tasks_of):
    found = []
    assert tasks_of(lambda: found.extend(images.list_images(spark, many).collect())) <= 16
    assert len({r.path for r in found}) == 60 and found == sorted(found)


def test_a_folder_is_written_down_in_few_files(spark, many, tasks_of):
    listing = ImageFolder(spark, many).listing()
    assert tasks_of(lambda: written(listing, "listing")) <= 16
    assert listing.count() == 60


def test_labelled_images_are_read_off_in_few_tasks(spark, many, tasks_of):
    found = []
    assert tasks_of(lambda: found.extend(images.labelled_images(spark, many, sample=50).collect())) <= 16
    assert len(found) == 50 and {tuple(r.truth) for r in found} == {("red",)}
