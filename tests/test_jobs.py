"""The composed jobs, with scorers defined here."""

import sys

import pytest
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from tagspark.operators import consistency, runs
from tagspark.operators.examples import draw_pool
from tagspark.plans import reports
from tagspark.plans.tagging_job import tag_items, to_history, to_results, to_tasks

# Scorers of this module travel with the job, as workers cannot import tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMPTY_MEMORY = ("key string, tags array<string>, rationale map<string,string>, "
                "details struct<category:string,product:string,description:string,specs:string>")
CORPUS = "key string, ord int, results array<struct<title:string,snippet:string,url:string>>"


def plain(answer):
    """A scorer that only names tags."""
    class Plain:
        def predict_tags(self, image_b64, media_type, context=None, examples=None):
            return list(answer)
    return Plain


def reasoning(first, second=None):
    """One answer at first, another once there is feedback, a reason per tag."""
    class Reasoning:
        def predict(self, image_b64, media_type, context=None, examples=None, feedback=None):
            tags = (second or first) if feedback else first
            return {"tags": tags, "reasons": {t: f"because {t}" for t in tags}, "category": "TV", "product": "seen",
                    "description": feedback or "", "input_tokens": 10, "output_tokens": 2}
    return Reasoning


def items(spark, *contents, folder="test/TV/MODEL-1"):
    return spark.createDataFrame([(f"{folder}/img_{i}.jpg", c.encode()) for i, c in enumerate(contents)],
                                 "path string, content binary")


def tagged(spark, scorer, *contents, **options):
    given = items(spark, *(contents or ("one",)), folder=options.pop("folder", "test/TV/MODEL-1"))
    return tag_items(given, scorer, model_id="stub-1", **options)


def only(run):
    row, = run.rows.collect()
    return row


def test_plain_scorer(spark):
    run = tagged(spark, plain(["Battery  Life", "velvet harbour", "CALL QUALITY", "battery life"]))
    row = only(run)
    assert row["tags"] == ["battery life", "call quality"] and row["attempts"] == 1 and not row["cached"]
    assert (row["category"], row["product"], row["description"], row["specs"]) == ("TV", "MODEL-1", "", "")
    assert row["context"] == "Category: TV, Model: MODEL-1" and row["model"] == "stub-1"
    assert run.calls.count() == 1


def test_weak_answers_are_asked_again_once(spark):
    weak = tagged(spark, reasoning(["velvet", "harbour hum", "colour"], ["indoor", "colour"]))
    row = only(weak)
    assert row["tags"] == ["indoor", "colour"] and row["attempts"] == 2 and weak.calls.count() == 2
    assert "'velvet', 'harbour hum'" in row["description"] and "colour" not in row["description"].replace("vocabulary", "")
    good = tagged(spark, reasoning(["indoor", "gaming"]))
    assert good.calls.count() == 1
    never = tagged(spark, reasoning(["velvet", "harbour hum"]))
    assert only(never)["tags"] == [] and never.calls.count() == 2
    once = tagged(spark, plain(["indoor", "velvet", "harbour hum"]), passes=1)
    assert only(once)["tags"] == ["indoor"] and once.calls.count() == 1


def test_reasons_of_kept_tags_only(spark):
    row = only(tagged(spark, reasoning(["comfort", "case", "velvet"])))
    assert row["rationale"] == {"comfort": "because comfort", "case": "because case"}


def test_context_beats_the_answer(spark):
    row = only(tagged(spark, reasoning(["top"]), folder="upload"))
    assert (row["category"], row["product"], row["context"]) == ("TV", "seen", None)
    told = items(spark, "x").withColumn("context", F.lit("Category: Mobile, Model: M1"))
    row = only(tag_items(told, reasoning(["top"]), model_id="m"))
    assert (row["category"], row["product"]) == ("Mobile", "M1")


class FailSecond:
    def predict_tags(self, image_b64, media_type, context=None, examples=None):
        import base64
        if base64.b64decode(image_b64) == b"bad":
            raise ValueError("torn page")
        return ["camera"]


def test_a_bad_item_does_not_end_the_run(spark):
    run = tagged(spark, FailSecond, "a", "bad", "c", "d")
    rows = {r["path"][-5]: r for r in run.rows.collect()}
    assert rows["1"]["tags"] == [] and rows["1"]["error"] == "ValueError: torn page"
    assert all(rows[i]["tags"] == ["camera"] and rows[i]["highlights"] == ["camera"] for i in "023")
    counted = runs.workflow_counters(to_tasks(run), "run_id").first()
    assert (counted["tasks"], counted["successes"], counted["failures"]) == (4, 3, 1)
    assert to_history(run.rows, "r1").count() == 3 and run.memory_rows.count() == 3
    assert {r["model"] for r in to_results(run.rows).collect()} == {"MODEL-1"}


def remembering(spark, rows=()):
    return spark.createDataFrame(list(rows), EMPTY_MEMORY)


def test_memory(spark):
    scorer = reasoning(["durability", "velvet harbour"])
    first = tagged(spark, scorer, "same", "same", "other", memory=remembering(spark))
    rows = {r["path"][-5]: r for r in first.rows.collect()}
    assert first.calls.count() == 2, "copies share one request"
    assert [rows[i]["cached"] for i in "012"] == [False, True, False]
    assert rows["1"]["attempts"] == 0 and rows["1"]["rationale"] == rows["0"]["rationale"]
    assert {tuple(r["tags"]) for r in first.memory_rows.collect()} == {("durability",)}
    second = tagged(spark, scorer, "same", "new", memory=first.memory_rows)
    rows = {r["path"][-5]: r for r in second.rows.collect()}
    assert second.calls.count() == 1 and rows["0"]["cached"] and not rows["1"]["cached"]
    assert rows["0"]["tags"] == ["durability"] and rows["0"]["category"] == "TV"
    elsewhere = tagged(spark, scorer, "same", memory=first.memory_rows, folder="test/Mobile/M2")
    assert elsewhere.calls.count() == 1, "another context is another request"
    assert tagged(spark, scorer, "same", "same").calls.count() == 2, "without memory every item is asked"


def test_an_empty_remembered_answer_is_a_hit(spark):
    first = tagged(spark, plain(["velvet"]), "x", memory=remembering(spark))
    again = tagged(spark, plain(["top"]), "x", memory=first.memory_rows)
    assert only(again)["cached"] and only(again)["tags"] == [] and again.calls.count() == 0


def corpus(spark, snippet="Took a prize at the spring show."):
    return spark.createDataFrame([("model-1", 0, [("r", snippet, "")])], CORPUS)


def test_enrichment(spark):
    scorer = plain(["indoor", "left"])
    assert only(tagged(spark, scorer, corpus=corpus(spark)))["tags"] == ["indoor", "left", "awards"]
    assert only(tagged(spark, scorer, corpus=corpus(spark, "nothing")))["tags"] == ["indoor", "left"]
    assert only(tagged(spark, scorer, corpus=corpus(spark), folder="upload"))["tags"] == ["indoor", "left"]
    rogue = {"velvet harbour": ["prize"]}
    assert only(tagged(spark, scorer, corpus=corpus(spark), rules=rogue))["tags"] == ["indoor", "left"]


def test_enriched_answers_are_remembered_apart(spark):
    scorer = plain(["bottom"])
    left = tagged(spark, scorer, memory=remembering(spark)).memory_rows
    enriched = tagged(spark, scorer, memory=left, corpus=corpus(spark))
    assert only(enriched)["tags"] == ["bottom", "awards"] and enriched.calls.count() == 1


class Peeking:
    """Names a tag for every example it is shown, and fails when shown its own answer."""

    def predict(self, image_b64, media_type, context=None, examples=None, feedback=None):
        shown = [list(e["tags"]) if isinstance(e, dict) else list(e.tags) for e in examples]
        return {"tags": ["top", *[t for tags in shown for t in tags]]}


def test_evaluation_never_shows_an_item_its_own_answer(spark):
    labelled = spark.createDataFrame([(f"TV/M/{i}.jpg", b"x", [t]) for i, t in enumerate(("colour", "left", "right"))],
                                     "path string, content binary, truth array<string>")
    report = reports.evaluate(labelled, Peeking, model_id="m", few_shot=2)
    records = {r["path"]: r for r in report.records.collect()}
    assert records["TV/M/0.jpg"]["predicted"] == ["top", "left", "right"]
    assert records["TV/M/2.jpg"]["predicted"] == ["top", "colour", "left"]
    metrics = report.metrics.first()
    assert metrics["n"] == 3 and metrics["micro_f1"] == 0.0
    assert report.workflow.first()["tasks"] == 3
    assert report.verdict.first()["beats_baseline"] is False
    plain_run = reports.evaluate(labelled, plain(["colour"]), model_id="m")
    assert plain_run.metrics.first()["micro_f1"] == pytest.approx(1 / 3)
    assert plain_run.failures.count() == 0 and plain_run.baselines.count() == 2


def test_stability(spark):
    given = items(spark, "a", "b")
    first = tag_items(given, plain(["top", "left"]), model_id="m")
    compared = reports.stability(first, given, plain(["top"]), model_id="m")
    assert tuple(consistency.summary(compared).first()) == (2, 0.5, 2)


def test_stability_draws_other_examples(spark):
    labelled = spark.createDataFrame([(f"TV/M/{i}.jpg", b"x", [t]) for i, t in enumerate(("colour", "left", "right", "case", "top"))],
                                     "path string, content binary, truth array<string>")
    given = labelled.drop("truth")
    first = tag_items(given, Peeking, model_id="m", pool=draw_pool(labelled, 2))
    compared = reports.stability(first, given, Peeking, model_id="m", labelled=labelled, few_shot=2)
    assert consistency.summary(compared).first()["mean_agreement"] < 1.0


class Placed:
    """Names the task that asks."""

    def predict_tags(self, image_b64, media_type, context=None, examples=None):
        return [f"task {TaskContext.get().partitionId()}"]


def test_both_runs_of_a_stability_job_ask_on_all_cores(spark, monkeypatch):
    from tagspark.plans import tagging_job
    monkeypatch.setattr(tagging_job, "IN_A_ROW", 10, raising=False)
    given = items(spark, *[f"item {i}" for i in range(400)]).coalesce(1)
    options = dict(model_id="m", vocabulary=[f"task {i}" for i in range(20)], highlight_family=["task 0"], passes=1)
    compared = reports.stability(tag_items(given, Placed, **options), given, Placed, **options)
    asked = compared.agg(F.count_distinct("first"), F.count_distinct("second"), F.count("path")).first()
    assert tuple(asked) == (8, 8, 400)


@pytest.mark.parametrize("most", [200_000, 0])
def test_images_do_not_move_and_many_requests_move_only_what_is_asked(spark, monkeypatch, most):
    from tagspark.plans import tagging_job
    monkeypatch.setattr(tagging_job, "BROADCAST_REQUESTS", most)
    seen, write = [], tagging_job.written

    def watching(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(tagging_job, "written", watching)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = tagged(spark, reasoning(["velvet", "harbour"], ["top"]), "a", "b", "a", memory=remembering(spark))
        assert {tuple(r["tags"]) for r in run.rows.collect()} == {("top",)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans = [p for name, p in seen if name.startswith("answers")]
    assert len(plans) == 2
    if most:
        assert not any("Exchange hashpartitioning" in p or "Sort " in p for p in plans)
    else:
        assert all("BroadcastExchange" in p and "Filter" in p for p in plans)


@pytest.mark.parametrize("parts, remembers, files", [(1, False, 8), (1, True, 8), (4, False, 4)])
def test_items_in_few_partitions_are_asked_about_on_all_cores(spark, monkeypatch, parts, remembers, files):
    from tagspark.plans import tagging_job
    monkeypatch.setattr(tagging_job, "IN_A_ROW", 10, raising=False)
    given = items(spark, *[f"item {i}" for i in range(400)]).coalesce(parts)
    run = tag_items(given, reasoning(["velvet", "harbour"], ["top"]), model_id="m", memory=remembering(spark) if remembers else None)
    asked = run.calls.groupBy("attempts", F.input_file_name().alias("file")).count().groupBy("attempts").agg(
        F.count("file").alias("files"), F.sum("count").alias("n")).collect()
    assert {r["attempts"]: (r["files"], r["n"]) for r in asked} == {1: (files, 400), 2: (files, 400)}
    assert {tuple(r["tags"]) for r in run.rows.collect()} == {("top",)}


def test_items_in_fewer_partitions_than_cores_are_dealt_out(spark, monkeypatch):
    from tagspark.plans import tagging_job
    monkeypatch.setattr(tagging_job, "IN_A_ROW", 10, raising=False)
    given = items(spark, *[f"item {i}" for i in range(400)]).coalesce(3)
    run = tag_items(given, plain(["top"]), model_id="m", passes=1)
    assert run.calls.select(F.input_file_name().alias("file")).distinct().count() == 8


class Counting:
    """Counts beyond what a float holds, some of them missing, as numbers and lists of several kinds."""

    def predict(self, image_b64, media_type, context=None, examples=None, feedback=None):
        n = int(context.split()[-1])
        return {"tags": (f"t{n}",), "input_tokens": None if n == 0 else 2 ** 53 + n, "output_tokens": float(n), "retries": "3",
                "reasons": {"t1": None}}


def test_fields_of_answers_come_back_whole(spark):
    from tagspark.plans.scoring import ask
    sent = spark.createDataFrame([(f"p{i}", f"k{i}", "", "image/png", f"n {i}", None) for i in range(3)],
                                 "path string, key string, content_b64 string, media_type string, context string, feedback string")
    got = ask(sent.coalesce(1), Counting).orderBy("path").collect()
    assert [(r["path"], r["key"], r["tags"], r["input_tokens"], r["output_tokens"], r["retries"]) for r in got] == [
        (f"p{i}", f"k{i}", [f"t{i}"], None if i == 0 else 2 ** 53 + i, i, 3) for i in range(3)]
    assert all(r["reasons"] == {"t1": None} and r["error"] is None and r["status"] is None for r in got)


def test_a_repeated_key_of_the_memory_counts_once(spark):
    scorer = plain(["top"])
    left = tagged(spark, scorer, "x", memory=remembering(spark)).memory_rows
    again = tagged(spark, scorer, "x", memory=left.unionByName(left))
    assert again.rows.count() == 1 and only(again)["cached"]


def test_run_report(spark):
    run = tagged(spark, reasoning(["top"]), "a", "b")
    prices = spark.createDataFrame([("stub", 1.0, 5.0)], "prefix string, usd_in double, usd_out double")
    report, latency = reports.run_report(to_tasks(run, "r"), run.calls.withColumn("run_id", F.lit("r")), prices)
    row = report.first()
    assert row["success_rate"] == 1.0 and row["cost_usd"] == pytest.approx(40e-6) and row["model_calls"] == 2
    assert row["cost_per_task_usd"] == pytest.approx(20e-6)
    assert latency.first()["calls"] == 2


def test_review_report(spark):
    run = tagged(spark, reasoning(["top", "camera"]), "a")
    meta = spark.createDataFrame([(0, "img_0.jpg", "TV", "X", "10", "5")],
                                 "ord int, file string, category string, product string, price string, views string")
    table, headline = reports.review_report(to_history(run.rows, "r1"), meta)
    row = table.first()
    assert row["Price"] == "10" and row["Highlights"] == "camera" and "Specs" not in table.columns
    assert headline.first()["images"] == 1
