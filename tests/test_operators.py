"""Operators on hand-checked tables, and against plain restatements on random ones."""

import random
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tagspark.operators import (
    consistency, engagement, evidence, examples, keyed, memory, metadata, order_stats, quality, results, review, runs,
    tagging)
from tagspark.sources.vocabulary import allowed_tags

HOT = {"hot_rows": 3}  # every key met more than three times is hot


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def judged(spark, truth, predicted):
    return spark.createDataFrame(
        [(i, f"p{i:04}", t, p) for i, (t, p) in enumerate(zip(truth, predicted))],
        "ord int, path string, truth array<string>, predicted array<string>")


def scores(df):
    return quality.micro_scores(df).first()["micro_f1"], quality.macro_f1(df).first()["macro_f1"]


@pytest.mark.parametrize("truth, predicted, micro, macro", [
    ([["physical design", "top"], ["colour"]], [["physical design", "top"], ["colour"]], 1.0, 1.0),
    ([["physical design", "top"], ["colour"]], [[], []], 0.0, 0.0),
    ([["physical design", "top"]], [["physical design", "colour"]], 0.5, 1 / 3),
    ([["top", "colour"]], [["colour", "top"]], 1.0, 1.0),
    ([["colour"]] * 3 + [["awards"]], [["colour", "gaming"]] * 3 + [["awards", "gaming"]], 2 / 3, 2 / 3),
    ([[]], [[]], 0.0, 0.0)])
def test_quality(spark, truth, predicted, micro, macro):
    assert scores(judged(spark, truth, predicted)) == pytest.approx((micro, macro))


def test_per_tag_support(spark):
    table = quality.per_tag_scores(judged(spark, [["colour"], ["colour"], ["top"]], [["colour"], [], ["top"]]))
    by_tag = {r["tag"]: r for r in table.collect()}
    assert by_tag["colour"]["support"] == 2 and by_tag["colour"]["recall"] == 0.5
    assert by_tag["top"]["f1"] == 1.0


def plain_scores(truth, predicted):
    def f1(tp, fp, fn):
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        return 2 * p * r / (p + r) if p + r else 0.0

    pairs = [(set(t), set(p)) for t, p in zip(truth, predicted)]
    tags = sorted(set().union(*[t | p for t, p in pairs]))
    whole = f1(*(sum(len(x) for x in xs) for xs in zip(*[(t & p, p - t, t - p) for t, p in pairs])))
    each = [f1(sum(g in t & p for t, p in pairs), sum(g in p - t for t, p in pairs), sum(g in t - p for t, p in pairs))
            for g in tags]
    return whole, sum(each) / len(each) if each else 0.0


def random_tags(rng, n):
    return [[rng.choice("abcdefg") for _ in range(rng.randint(0, 4))] for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_on_random_tables(spark, seed):
    rng = random.Random(seed)
    truth, predicted = random_tags(rng, 60), random_tags(rng, 60)
    df = judged(spark, truth, predicted)
    assert scores(df) == pytest.approx(plain_scores(truth, predicted))
    counts = Counter(t for tags in truth for t in tags)
    size = sorted(map(len, truth))[len(truth) // 2]
    top = [t for t, _ in counts.most_common(size)]
    got = {r["name"]: (r["micro_f1"], r["macro_f1"]) for r in quality.compare_baselines(df).collect()}
    best = counts.most_common(1)[0][0]
    assert got["agent"] == pytest.approx(plain_scores(truth, predicted))
    assert got[f"constant ({best})"] == pytest.approx(plain_scores(truth, [[best]] * 60))
    assert got[f"prior top-{size} ({', '.join(top)})"] == pytest.approx(plain_scores(truth, [top] * 60))
    assert len(got) == 3


BASE = [["physical design", "front angle"], ["physical design", "side angle"], ["physical design", "front angle"]]


def test_baselines_and_verdict(spark):
    df = judged(spark, BASE, [["physical design"]] * 3)
    assert [r["tag"] for r in tagging.top_tags(df, 1, "truth").collect()] == ["physical design"]
    assert [r["tag"] for r in tagging.top_tags(df, 9, "truth").collect()] == ["physical design", "front angle", "side angle"]
    got = {r["name"]: r["micro_f1"] for r in quality.compare_baselines(df).collect()}
    assert got["agent"] == pytest.approx(got["constant (physical design)"]) and len(got) == 3
    said = quality.verdict(quality.compare_baselines(judged(spark, BASE, BASE))).first()
    assert said["beats_baseline"] and said["micro_target_met"] and said["macro_target_met"]


def test_median_label_size(spark):
    def size(sizes):
        df = spark.createDataFrame([(["x"] * n,) for n in sizes], "tags array<string>")
        return tagging.median_label_size(df).first()["median_size"]

    assert [size([1, 2, 3, 4]), size([3]), size([0, 0, 5]), size([])] == [3, 3, 0, 0]


def test_failures(spark):
    df = spark.createDataFrame([(0, None), (1, "APIError: 500"), (2, ""), (3, "Timeout"), (4, "APIError: 501: x")],
                               "ord int, error string")
    assert rows_of(quality.failure_kinds(df)) == [("APIError", 2), ("Timeout", 1)]
    assert rows_of(quality.failure_summary(df)) == [(3, 5, "APIError: 500")]


def test_drift(spark):
    df = tagging.validated(spark.createDataFrame(
        [(0, ["Camera", "shiny", "shiny"]), (1, ["top"])], "ord int, raw array<string>"), allowed_tags())
    assert rows_of(tagging.drift(df)) == [(2, 1, 2, 4, 0.5)]
    assert [r["tag"] for r in tagging.dropped_counts(df).collect()] == ["shiny"]


def engagement_rows(spark, rows):
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "ord int, tags array<string>, views string")


JOINED = [(["oak"], "12"), (["oak"], "60"), (["elm"], "30"), (["elm"], "18")]


def test_engagement(spark):
    got = rows_of(engagement.tag_engagement(engagement_rows(spark, JOINED + [(["oak"], "n/a")])))
    assert got == [("oak", 2, 36.0, 36.0, pytest.approx(1.2)), ("elm", 2, 24.0, 24.0, pytest.approx(0.8))]
    thin = engagement.tag_engagement(engagement_rows(spark, JOINED + [(["yew"], "7,000")]))
    assert "yew" not in [r["tag"] for r in thin.collect()]
    assert rows_of(engagement.tag_engagement(engagement_rows(spark, [(["oak"], None)]))) == []


def test_engagement_counts_untagged_rows_and_repeats(spark):
    got = rows_of(engagement.tag_engagement(engagement_rows(
        spark, [(["a", "a"], "10"), ([], "40"), (["b", "b"], "0")])))
    assert got == [("a", 2, 10.0, 10.0, pytest.approx(0.6)), ("b", 2, 0.0, 0.0, 0.0)]
    zero = rows_of(engagement.tag_engagement(engagement_rows(spark, [(["b"], "0"), (["b"], "0")])))
    assert zero == [("b", 2, 0.0, 0.0, 0.0)]


def nearest(values, percent):
    ordered = sorted(values)
    return ordered[min(int(round(percent / 100 * (len(ordered) - 1))), len(ordered) - 1)]


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_ranks_do_not_depend_on_how_groups_are_cut(spark, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, (partitions, "false")):
        spark.conf.set(k, v)
    try:
        check_ranks(spark)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def check_ranks(spark):
    rng = random.Random(5)
    groups = {"even": [float(rng.randint(0, 30)) for _ in range(200)], "one": [7.0], "odd": [rng.random() for _ in range(101)],
              "same": [3.0] * 50, "four": [1.0, 2.0, 3.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "action string, ms double")
    got = {r["action"]: r["m"] for r in order_stats.medians(df, ["action"], "ms", "m").collect()}
    assert got == {g: median(vs) for g, vs in groups.items()}
    latency = {r["action"]: tuple(r)[1:] for r in runs.latency_per_action(df).collect()}
    assert latency == {g: (len(vs), nearest(vs, 50), nearest(vs, 95)) for g, vs in groups.items()}


def test_latency_case(spark):
    df = spark.createDataFrame([("model", float(v)) for v in (100, 200, 300, 400, 900)], "action string, ms double")
    assert rows_of(runs.latency_per_action(df)) == [("model", 5, 300.0, 900.0)]


def test_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, ord int, v string")
    assert sorted(rows_of(keyed.last_per_key(df, ["k"], F.col("ord")))) == [("a", 2, None), ("b", 1, "z")]
    assert sorted(rows_of(keyed.first_per_key(df, ["k"], F.col("ord")))) == [("a", 1, "x"), ("b", 1, "z")]


@pytest.mark.parametrize("hot", [{}, HOT])
def test_lookup_is_the_same_for_hot_keys(spark, hot):
    left = spark.createDataFrame(
        [(i, None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 5}") for i in range(200)], "ord int, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3), (None, 4)], "k string, v int")
    got = {r["ord"]: r["v"] for r in keyed.lookup(left, right, ["k"], F.col("ord"), **hot).collect()}
    assert got == {r["ord"]: {"hot": 1, "k2": 2}.get(r["k"]) for r in left.collect()}


def sheet(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "ord int, file string, category string, product string, price string, views string")


@pytest.mark.parametrize("hot", [{}, HOT])
def test_two_tier_join(spark, hot):
    meta = sheet(spark, [("a.jpg", "TV", "X", "1", "10"), ("b.jpg", "TV", "Y", "2", "20"), ("a.jpg", "Mobile", "Z", "3", "30"),
                         ("a.jpg", " tv ", "x", "4", "40")])
    given = [(0, "/img/a.jpg", "TV", "X"), (1, "/img/zz.jpg", "TV", "X"), (2, "/img/a.jpg", None, "?"),
             (3, "a.jpg", "MOBILE ", " z"), (4, "/b.jpg", "", "")]
    df = spark.createDataFrame(given * 1, "ord int, path string, category string, model string")
    got = {r["ord"]: (r["category"], r["product"], r["views"]) for r in metadata.join_two_tier(df, meta, **hot).collect()}
    assert got == {0: (" tv ", "x", "40"), 2: ("TV", "X", "10"), 3: ("Mobile", "Z", "30"), 4: ("TV", "Y", "20")}
    assert rows_of(engagement.match_coverage(df, metadata.join_two_tier(df, meta))) == [(5, 4)]


def test_rows_from_sheet(spark):
    got = metadata.rows_from_sheet(sheet(spark, [
        ("['physical design', 'top'].jpg", None, None, None, "5"), ("unlabelled.jpg", None, None, None, "5")])).collect()
    assert [(r["path"], r["tags"]) for r in got] == [("['physical design', 'top'].jpg", ["physical design", "top"])]


def test_product_medians(spark):
    meta = sheet(spark, [("a", "c1", " x ", "10", "1"), ("b", "c2", "X", "20", "n/a"), ("a", "c3", "x", "40", "nan"),
                         ("c", "c4", "", "1", "1"), ("d", "c5", "y", "1,000", None)])
    got = {r["product_key"]: tuple(r)[1:] for r in metadata.product_medians(meta).collect()}
    # file a keeps its last row and its first place
    assert got == {"X": ("c3", 30.0, None, 2), "Y": ("c5", None, None, 1)}
    every = {r["product_key"]: tuple(r)[1:] for r in metadata.product_medians(meta, dedupe_by_file=False).collect()}
    assert every["X"] == ("c1", 20.0, 1.0, 3)


def test_context_from_metadata(spark):
    items = spark.createDataFrame([(0, "/x/a.jpg"), (1, "b.jpg"), (2, "c.jpg")], "ord int, path string")
    meta = sheet(spark, [("a.jpg", "old", "old", None, None), ("a.jpg", "TV", "X", None, None), ("b.jpg", "", "Y", None, None)])
    got = metadata.contexts_from_metadata(items, meta).orderBy("ord").collect()
    assert [r["context"] for r in got] == ["Category: TV, Model: X", "Model: Y", ""]


def passes(spark, rows):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "ord int, path string, tags array<string>")


def test_consistency(spark):
    first = passes(spark, [("/x/a.jpg", ["colour", "top"]), ("/x/b.jpg", ["colour"]), ("/x/c.jpg", ["colour"]), ("/x/d.jpg", [])])
    second = passes(spark, [("/x/c.jpg", ["no"]), ("/x/b.jpg", ["top"]), ("/x/a.jpg", ["top", "colour"]),
                            ("/x/c.jpg", ["colour", "top"])])
    compared = consistency.compare_passes(first, second, **HOT)
    assert rows_of(consistency.summary(compared)) == [(3, 0.5, 2)]
    assert [r["image"] for r in consistency.unstable(compared).collect()] == ["b.jpg", "c.jpg"]
    assert [r["image"] for r in consistency.unstable(compared, worst=1).collect()] == ["b.jpg"]
    assert rows_of(consistency.summary(compared.limit(0))) == [(0, 0.0, 0)]


def tasks(spark, rows):
    return spark.createDataFrame(rows, "run_id string, model_id string, n_tags int, failed boolean, cached boolean, "
                                       "retries int, model_calls int, input_tokens bigint, output_tokens bigint")


def card(spark):
    return spark.createDataFrame([("small-4", 1.0, 5.0), ("small", 9.0, 9.0), ("", None, None)][:2],
                                 "prefix string, usd_in double, usd_out double")


def test_run_metrics(spark):
    df = tasks(spark, [("r", "small-4-2025", 2, False, False, 1, 1, 1_000_000, 200_000),
                       ("r", "small-4-2025", 0, True, True, 0, 2, 0, 0), ("r", "other", 3, False, False, 0, 1, 5000, 50)])
    assert rows_of(runs.success_rate(df, "run_id")) == [("r", 3, 2, pytest.approx(2 / 3))]
    assert rows_of(runs.success_rate(df.limit(0))) == [(0, 0, 0.0)]
    assert rows_of(runs.workflow_counters(df, "run_id")) == [("r", 3, 2, 1, 1, 1, 4, 1_005_000, 200_050)]
    cost = {r["model_id"]: (r["cost_usd"], r["cost_per_task_usd"]) for r in runs.costs(df, card(spark), "run_id").collect()}
    assert cost == {"small-4-2025": (pytest.approx(2.0), pytest.approx(1.0)), "other": (None, None)}


def test_memory_split(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("aabcbbbbb")], "ord int, key string")
    known = spark.createDataFrame([("c",), ("z",)], "key string")
    split = memory.split_requests(df, known, **HOT)
    got = {r["ord"]: r["source"] for r in split.collect()}
    assert got == {0: "scorer", 1: "batch", 2: "scorer", 3: "memory", **{i: "batch" for i in range(4, 9)}}
    assert rows_of(memory.memory_summary(split, known)) == [(7, 2, pytest.approx(700 / 9), 4)]


def test_results(spark):
    rows = spark.createDataFrame([("r1", "/x/b.jpg", 1, 0, "old"), ("r1", "/x/b.jpg", 2, 1, "new"), ("r1", "/y/a.jpg", 1, 2, "x"),
                                  ("r2", "/x/b.jpg", 2, 5, "tie"), ("r2", "/x/b.jpg", 2, 6, "last")],
                                 "run_id string, image_path string, created int, write_ord int, v string")
    latest = results.latest_results(rows)
    assert sorted(r["v"] for r in latest.collect()) == ["last", "new", "x"]
    assert [r["run_id"] for r in results.runs_summary(rows).collect()] == ["r1", "r2"]
    assert [r["v"] for r in results.run_rows(rows).collect()] == ["x", "new"]
    assert [r["v"] for r in results.run_rows(rows, "r2").collect()] == ["last"]
    assert [r["v"] for r in results.run_rows(rows, limit=1).collect()] == ["x"]


def test_examples(spark):
    df = spark.createDataFrame([(f"p{i}", [f"t{i}"]) for i in (2, 0, 1, 3)], "path string, truth array<string>")
    got = {r["path"]: [e["path"] for e in r["examples"]] for r in examples.leave_one_out(df, df, 2).collect()}
    assert got == {"p0": ["p1", "p2"], "p1": ["p0", "p2"], "p2": ["p0", "p1"], "p3": ["p0", "p1"]}
    assert rows_of(examples.draw(df, 0)) == []
    draws = {s: tuple(r["path"] for r in examples.draw(df, 2, seed=s).collect()) for s in range(10)}
    assert draws[3] == tuple(r["path"] for r in examples.draw(df, 2, seed=3).collect())
    assert len(set(draws.values())) > 1
    seeded = {r["path"]: [e["path"] for e in r["examples"]] for r in examples.leave_one_out(df, df, 3, seed=4).collect()}
    assert all(path not in shown and len(shown) == 3 for path, shown in seeded.items())


def results_column(*texts):
    return F.array(*[F.struct(F.lit(t).alias("title"), F.lit(s).alias("snippet")) for t, s in texts]).cast(
        "array<struct<title:string,snippet:string>>")


def test_evidence_rules(spark):
    def earned(*texts):
        return spark.range(1).select(evidence.tags_from_results(results_column(*texts)).alias("t")).first()["t"]

    assert earned(("a", "Winner of the EISA best OLED award"), ("b", "another award")) == ["awards"]
    assert earned(("r", "a step towards better sound")) == []
    assert earned() == []
    assert earned(("r", "an Editor's choice; measured. EU energy rating")) == ["awards", "benchmark", "energy rating"]
    assert earned(("r", "energy"), ("rating", "of G")) == ["energy rating"]


def test_evidence_by_entity(spark):
    df = spark.createDataFrame([("x", "", "no"), ("x", "lab test", ""), ("y", "", "towards"), ("x", "", "prizes")],
                               "entity string, title string, snippet string")
    got = {r["entity"]: r["tags"] for r in evidence.tags_by_entity(df).collect()}
    assert got == {"x": ["awards", "benchmark"], "y": []}


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 0}])
def test_find_evidence(spark, hot):
    corpus = spark.createDataFrame([("wh-1", 2, "a"), ("xr", 1, "b"), ("wh-10", 0, "c"), ("", 9, "any"), ("X", 0, "never")],
                                   "key string, ord int, url string").select("key", "ord", F.array(F.struct("url")).alias("results"))
    queries = spark.createDataFrame([("Acme WH-10 xr",), ("the XR",), ("nothing",), ("wh-1",)], "query string")
    got = {r["query"]: r["results"][0]["url"] for r in evidence.find_evidence(queries, corpus, **hot).collect()}
    assert got == {"Acme WH-10 xr": "c", "the XR": "b", "nothing": "any", "wh-1": "a"}
    some = evidence.find_evidence(queries, corpus.filter("key <> ''"), **hot)
    assert [r["query"] for r in some.filter("results is null").collect()] == ["nothing"]


@pytest.mark.parametrize("hot", [{}, HOT])
def test_review(spark, hot):
    rows = spark.createDataFrame([
        ("/r/a.jpg", ["camera"], ["camera"], {"camera": "x"}, "", "", None, None, 1, False),
        ("/r/q.jpg", ["top", "left"], [], {"top": "x", "left": "y"}, " px", "", "d", "", 1, True),
        ("/r/n.jpg", [], [], {}, "unknown", "Mobile", "", "", 2, False)],
        "image_path string, tags array<string>, highlights array<string>, rationale map<string,string>, product string, "
        "category string, description string, specs string, attempts int, cached boolean")
    meta = sheet(spark, [("a.jpg", "TV", "PA", "1234.5", "1,5"), ("b.jpg", "AV", "PX", "10", "7"), ("c.jpg", "AV", "PX", "20", None)])
    known = review.with_metadata(rows, meta, **hot)
    table = {r["Image name"]: r for r in review.review_table(known).collect()}
    a, q, n = table["a.jpg"], table["q.jpg"], table["n.jpg"]
    assert (a["Product"], a["Category"], a["Price"], a["Views"]) == ("PA", "TV", "1,234", "")
    assert (a["How sure? (confidence)"], a["Why (signals)"]) == ("Medium", "only one tag")
    assert (q["Product"], q["Category"], q["Price"], q["Views"]) == (" px", "AV", "15", "7")
    assert q["How sure? (confidence)"] == "High" and q["Marketing tags"] == "top, left"
    assert (n["Category"], n["Price"], n["How sure? (confidence)"]) == ("Mobile", "", "Needs a look")
    assert rows_of(review.headline(known)) == [(3, 1, 1, 1, 1)]
    assert "Specs" not in review.without_blank_columns(review.review_table(known)).columns
    assert "Description" in review.without_blank_columns(review.review_table(known)).columns
    assert [r["image_path"] for r in review.untagged(rows).collect()] == ["/r/n.jpg"]
    assert len(review.explained(rows).collect()) == 2


def test_matches(spark):
    t = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x"])], "path string, tags array<string>")
    p = spark.createDataFrame([("a", ["y", "z"]), ("c", ["x"])], "path string, tags array<string>")
    got = sorted(rows_of(quality.matches(t, p)))
    assert got == [("a", "x", True, False), ("a", "y", True, True), ("a", "z", False, True), ("b", "x", True, False),
                   ("c", "x", False, True)]


def test_tag_counts_keep_first_seen_order(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (0, ["c", "a"]), (2, ["b"])], "ord int, tags array<string>")
    assert [(r["tag"], r["n"]) for r in tagging.ranked(tagging.tag_counts(df)).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    terms = spark.createDataFrame([("a",), ("zz",)], "tag string")
    flat = df.select("ord", F.explode("tags").alias("tag"))
    assert tagging.in_vocabulary(flat, terms).count() == 2 and tagging.in_vocabulary(flat, terms, keep=False).count() == 3
    assert defaultdict(int, {r["tag"]: r["n"] for r in tagging.tag_counts(df).collect()})["c"] == 1
