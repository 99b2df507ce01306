"""Files in, files out."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tagspark.sources import images, records, sheet, stores, vocabulary

PNG, JPEG = b"\x89PNG\r\n\x1a\n....", b"\xff\xd8\xff\xe0...."


def put(folder, name, content=JPEG):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


def names(df):
    return [os.path.basename(r["path"]) for r in df.collect()]


def test_images(spark, folder):
    for name in ("b/B.JPG", "a/z.webp", "a/x.jpeg", "a/note.txt", "c.png", "b/.jpg"):
        put(folder, name, PNG if name == "a/x.jpeg" else JPEG)
    paths = [r["path"] for r in images.list_images(spark, folder).collect()]
    assert paths == [os.path.join(folder, n) for n in ("a/x.jpeg", "a/z.webp", "b/B.JPG", "c.png")]
    assert names(images.list_images(spark, folder, limit=2)) == ["x.jpeg", "z.webp"]
    assert len(names(images.list_images(spark, folder, limit=0))) == 4
    kinds = {os.path.basename(r["path"]): r["media_type"] for r in images.encoded_images(spark, folder).collect()}
    assert kinds["x.jpeg"] == "image/png" and kinds["c.png"] == "image/jpeg"


def test_large_files_of_other_kinds_are_not_read(spark, folder):
    put(folder, "a.JPG", JPEG)
    put(folder, "clip.mp4", b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert [r["media_type"] for r in images.encoded_images(spark, folder).collect()] == ["image/jpeg"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_listing_reads_no_bytes(spark, folder):
    put(folder, "a.jpg")
    plan = images.list_images(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_labelled_images(spark, folder):
    for name in ("['physical design', 'top'].jpg", "plain.jpg", "['Colour'].jpg"):
        put(folder, f"train/Mobile/XPERIA/{name}")
    got = images.labelled_images(spark, folder).collect()
    assert [r["truth"] for r in got] == [["colour"], ["physical design", "top"]]
    assert images.labelled_images(spark, folder, sample=1).count() == 1


def test_sheet(spark, folder):
    path = os.path.join(folder, "m.csv")
    with open(path, "w") as f:
        f.write('Name,Category,Model,Image views,Product price,Extra\n'
                '"x/a.jpg ",TV,X,"1,234",9.5,e\nb.jpg,,,n/a,,e\n"[\'a, ""b""\'].jpg",T,Y,5,6,e\n')
    got = sheet.read_sheet(spark, path).orderBy("ord").drop("ord").collect()
    assert [tuple(r) for r in got] == [
        ("a.jpg", "TV", "X", "9.5", "1,234"), ("b.jpg", None, None, None, "n/a"), ("['a, \"b\"'].jpg", "T", "Y", "6", "5")]
    with open(path, "w") as f:
        f.write("random\n1\n")
    with pytest.raises(ValueError, match="file-name column"):
        sheet.read_sheet(spark, path)


def test_sheet_in_many_tasks_keeps_the_order_of_its_rows(spark, folder):
    path = os.path.join(folder, "long.csv")
    with open(path, "w") as f:
        f.write("Name,Price\n" + "".join(f"f{i}.jpg,{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = sheet.read_sheet(spark, path)
        assert read.rdd.getNumPartitions() > 4
        assert [r["price"] for r in read.orderBy("ord").collect()] == [str(i) for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(path, "w") as f:
        f.write('Name,Price\na.jpg,"1\n2"\nb.jpg,3\n')
    assert [r["price"] for r in sheet.read_sheet(spark, path, multi_line=True).orderBy("ord").collect()] == ["1\n2", "3"]


def test_vocabulary_file(spark, folder):
    path = os.path.join(folder, "v.json")
    with open(path, "w") as f:
        json.dump({"taxonomy": {"a": ["a"], "b": ["c", "d"]}, "observed_extra": ["d", "e"]}, f, indent=1)
    got = {(r["general"], r["tag"]) for r in vocabulary.read_vocabulary(spark, path).collect()}
    assert got == {("a", "a"), ("b", "b"), ("b", "c"), ("b", "d"), (None, "e")}


def test_results_round_trip(spark, folder):
    rows = spark.createDataFrame([("/x/a.jpg", "TV", "M", ["a", 'b "q"'], ["a"])], records.RESULTS)
    records.write_results(rows, f"{folder}/r")
    records.write_results(rows, f"{folder}/r.csv")
    assert spark.read.csv(f"{folder}/r.csv", header=True, escape='"').first().asDict() == {
        "path": "/x/a.jpg", "category": "TV", "model": "M", "highlights": "a", "tags": 'a; b "q"'}
    with open(f"{folder}/one.json", "w") as f:
        json.dump([{"path": "p1", "tags": ["a"]}, {"path": "p2", "tags": [], "highlights": []}], f, indent=2)
    assert [r["path"] for r in records.read_results(spark, f"{folder}/one.json", as_array=True).orderBy("ord").collect()] == ["p1", "p2"]


def test_results_keep_rows_and_order(spark, folder):
    rows = spark.createDataFrame([(f"p{i}", None, None, [str(i)], [], 99 - i) for i in range(100)], f"{records.RESULTS}, ord bigint")
    records.write_results(rows.repartition(3), f"{folder}/lines")
    got = records.read_results(spark, f"{folder}/lines").orderBy("ord").collect()
    assert [r["path"] for r in got] == [f"p{99 - i}" for i in range(100)]
    records.write_results(rows.drop("ord").coalesce(1), f"{folder}/unnumbered")
    assert records.read_results(spark, f"{folder}/unnumbered").select("ord").distinct().count() == 100


def test_run_records(spark, folder):
    assert records.recorded_settings({"provider": "p", "limit": None, "enrich": False, "few_shot": 0, "sample": 0.0, "verbose": True}) == {
        "provider": "p"}
    assert records.recorded_settings({"provider": "p", "workers": 1, "from_sheet": True, "metric": "views"}) == {
        "from_sheet": True, "metric": "views"}
    payload = spark.createDataFrame([(3,)], "images int")
    first = records.write_run_record(payload, "tag", {"model": "m", "limit": 5}, folder, dt.datetime(2026, 1, 1))
    assert first.endswith("20260101-000000_tag.json")
    assert records.write_run_record(payload, "tag", {}, folder, dt.datetime(2026, 1, 1)) is None, "must not fail the run"
    records.write_run_record(spark.createDataFrame([(4,)], "images int"), "eval", {}, folder, dt.datetime(2026, 1, 2))
    with open(f"{folder}/20250101-000000_tag.json", "w") as f:
        json.dump({"images": 1}, f, indent=2)
    assert records.newest_record(spark, folder).first()["images"] == 4
    newest = records.newest_record(spark, folder, "tag").first()
    assert newest["images"] == 3 and newest["settings"]["limit"] == 5 and newest["command"] == "tag"
    assert newest["started_at"] == "2026-01-01T00:00:00"
    assert records.newest_record(spark, folder, "insights") is None


def result_row(**given):
    row = {"run_id": "r1", "image_path": "/x/a.jpg", "tags": ["colour"], "highlights": [], "rationale": {"colour": "x"},
           "category": "TV", "product": "X", "description": "d", "specs": "s", "model": "m", "attempts": 1, "cached": False,
           "created": dt.datetime(2026, 1, 1), "write_ord": 0}
    return {**row, **given}


def test_history(spark, folder):
    def rows(*given):
        return spark.createDataFrame([result_row(**g) for g in given], stores.RESULT_ROWS)

    path = f"{folder}/history"
    rows({}).drop("description", "specs").write.partitionBy("run_id").parquet(path)
    assert stores.read_history(spark, path).first()["description"] is None
    stores.put_results(rows({"run_id": "20260102", "image_path": "/x/b.jpg"},
                            {"tags": ["top"], "created": dt.datetime(2026, 1, 2)}), path)
    got = {(r["run_id"], r["image_path"]): r for r in stores.read_history(spark, path).collect()}
    assert len(got) == 2 and got["r1", "/x/a.jpg"]["tags"] == ["top"] and got["r1", "/x/a.jpg"]["specs"] == "s"
    assert got["20260102", "/x/b.jpg"]["rationale"] == {"colour": "x"}
    plan = stores.read_history(spark, path).filter("run_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_history_of_many_runs_shares_files(spark, folder, monkeypatch):
    monkeypatch.setattr(stores, "RUN_FOLDERS", 3)

    def rows(runs, **given):
        return spark.createDataFrame([result_row(run_id=f"r{i}", **given) for i in runs], stores.RESULT_ROWS)

    path = f"{folder}/history"
    stores.append_results(rows(range(40)).drop("description", "specs"), path)
    stores.put_results(rows(range(20, 60), tags=["top"], created=dt.datetime(2026, 1, 2)), path)
    assert not [name for name in os.listdir(path) if name.startswith("run_id=")]
    stores.put_results(rows(range(3), tags=["last"], created=dt.datetime(2026, 1, 3)), path)
    assert sorted(name for name in os.listdir(path) if name.startswith("run_id=")) == ["run_id=r0", "run_id=r1", "run_id=r2"]
    got = {r["run_id"]: (r["tags"], r["specs"]) for r in stores.read_history(spark, path).collect()}
    assert got == {f"r{i}": (["last"], "s") if i < 3 else (["colour"], None) if i < 20 else (["top"], "s") for i in range(60)}
    one = stores.read_history(spark, path).filter("run_id = 'r30'")
    assert [r["tags"] for r in one.collect()] == [["top"]]
    assert "PushedFilters: [IsNotNull(run_id), EqualTo(run_id,r30)]" in one._jdf.queryExecution().executedPlan().toString()


def test_memory(spark, folder):
    none = ("", "", "", "")
    path = f"{folder}/memory"
    for day, tags in ((1, ["a"]), (2, [])):
        stores.remember(spark.createDataFrame(
            [("k", tags, {"a": "why"}, none, "m", dt.datetime(2026, 1, day)), (f"k{day}", ["x"], {}, none, "m", dt.datetime(2026, 1, day))],
            stores.MEMORY), path)
    got = {r["key"]: r["tags"] for r in stores.read_memory(spark, path).collect()}
    assert got == {"k": [], "k1": ["x"], "k2": ["x"]}
    stores.compact_memory(spark, path, f"{folder}/compact")
    assert spark.read.parquet(f"{folder}/compact").count() == 3


def test_memory_payloads(spark):
    df = spark.createDataFrame([(0, '["colour"]'), (1, json.dumps(
        {"tags": ["colour"], "rationale": {"colour": "three"}, "details": {"specs": "5000mAh", "category": "Mobile"}})), (2, "{}")],
        "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(stores.remembered_payload(F.col("p"))).collect()]
    assert (got[0]["tags"], got[0]["rationale"], got[0]["details"]) == (["colour"], {}, None)
    assert got[1]["rationale"] == {"colour": "three"} and got[1]["details"]["specs"] == "5000mAh"
    assert (got[2]["tags"], got[2]["rationale"]) == ([], {})


def test_log_and_exports(spark, folder):
    with open(f"{folder}/log.jsonl", "w") as f:
        f.write('{"event": "model_call", "ms": 10, "image": "a"}\n{"event": "model_call", "ms": 20}\n{"event": "memory_hit"}\nnot json\n')
    from tagspark.operators.runs import log_rollup
    got = {r["event"]: (r["n"], r["mean_ms"]) for r in log_rollup(records.read_log(spark, f"{folder}/log.jsonl")).collect()}
    assert got["model_call"] == (2, 15.0) and got["memory_hit"] == (1, None)
    one = spark.createDataFrame([("a, b", 'say "x"')], "`Image name` string, Why string")
    records.write_review(one, f"{folder}/review")
    assert tuple(spark.read.csv(f"{folder}/review", header=True, escape='"').first()) == ("a, b", 'say "x"')
    parts = ["baselines", "metrics", "per_tag", "records", "verdict", "workflow"]
    records.write_evaluation(f"{folder}/eval", **{p: one.withColumn("part", F.lit(p)) for p in parts})
    assert sorted(os.listdir(f"{folder}/eval")) == parts
    assert all(spark.read.json(f"{folder}/eval/{p}").first()["part"] == p for p in parts)
