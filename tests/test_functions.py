"""Expressions, on the cases the specification names and on edge cases."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions import answers, images, paths, tags, text
from tagspark.plans.prompts import prompt
from tagspark.sources.sheet import recognise
from tagspark.sources.vocabulary import allowed_tags, family, vocabulary_text


def each(spark, values, fn, schema="v string"):
    """fn of every value, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["out"] for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def one(spark, value, fn, schema="v string"):
    return each(spark, [value], fn, schema)[0]


def test_normalise(spark):
    assert each(spark, ["Side  Angle", "  FRONT ANGLE ", "a b\t\x1cc", ""], text.normalise) == [
        "side angle", "front angle", "a b c", ""]


def test_vocabulary():
    terms = allowed_tags()
    assert len(terms) == len(set(terms)) == 43
    assert {"physical design", "front angle", "camera", "left", "right"} <= set(terms)
    assert "velvet harbour" not in terms
    assert "camera" in family() and len(family()) == 16
    assert "- awards\n" in vocabulary_text()
    assert "- usage scene: indoor, outdoor, transport" in vocabulary_text()


def test_numbers(spark):
    given = ["1,234", " 5 ", "n/a", "nan", None, "1_000", "1d", "inf", "-Infinity", "1e3", ".5", "5.", "1__0", "0x1"]
    assert each(spark, given, text.tolerant_number) == [
        1234.0, 5.0, None, None, None, 1000.0, None, float("inf"), float("-inf"), 1000.0, 0.5, 5.0, None, None]
    assert each(spark, ["1234.5", "1235.5", "1,234", "", None, "nan", "-0.4", "inf"], text.display_number) == [
        "1,234", "1,236", "", "", "", "", "-0", "inf"]


def test_tags_from_name(spark):
    got = each(spark, [
        "['indoor', 'back angle', 'case'].jpg", "/shots/spring/['Battery  LIFE'].jpg",
        "shelf_4.jpg", "['half.jpg", "[bare, words].jpg", "['a', \"b\",].jpg", "['a'] x ].jpg", "[].jpg",
        "['a' 'b', 3, True].jpg", "['it\\'s'].jpg", "x[y]/plain.jpg", "['a',,].jpg", None], paths.tags_from_name)
    assert got == [
        ["indoor", "back angle", "case"], ["battery life"], [], [], [], ["a", "b"], [], [],
        ["ab", "3", "true"], ["it's"], [], [], []]


def test_context_from_path(spark):
    got = each(spark, [
        "in/box/TV/KT-40/p.jpg", "in/box/Video & Sound/QP-7/p.jpg", "/var/q77.jpg",
        "tv/A/speaker/img.jpg", "Mobile/a.jpg", "x/mobile/M1/TV/M2/a.jpg", "TV//./X/../Y/a.jpg", "TV"],
        paths.context_from_path)
    assert got == [
        "Category: TV, Model: KT-40", "Category: Video & Sound, Model: QP-7", "",
        "Category: speaker, Model: A", "Category: Mobile", "Category: TV, Model: M2", "Category: TV, Model: Y", ""]


def test_split_context(spark):
    got = each(spark, ["Category: TV, Model: KT-40", "MODEL: x: y", "category: a, Category: b", "", None],
               paths.split_context)
    assert [tuple(r) for r in got] == [("TV", "KT-40"), ("", "x: y"), ("b", ""), ("", ""), ("", "")]


def test_lookup_query_and_position(spark):
    asked = one(spark, "Category: TV, Model: X1", lambda c: paths.lookup_query(c, "Acme"))
    assert asked.startswith("Acme TV   X1: has it won any awards")
    assert each(spark, ["a_B09_3_12.jpg", "shot.jpg", "7.jpg", "a_123.jpg"], paths.carousel_position) == [3, 1, 7, 1]


def test_tag_array(spark):
    got = each(spark, [
        '["left", "right"]', '```json\n["case"]\n```', 'So: ["gaming"] it is', "", None,
        "nothing listed", "[half", '["in", ["deep"]]', '["in", 8]', '["in", {"k": 2}]',
        '["a", null, true, 1.5, 1.0, 12345678901234567890]', '["a"] and ["b"]', "[]"], answers.tag_array)
    assert got == [
        ["left", "right"], ["case"], ["gaming"], [], [], [], [], [], ["in", "8"], ["in"],
        ["a", "True", "1.5", "1.0", "12345678901234567890"], ["a"], []]


ANSWER = ("indoor - a lamp stands behind it\n"
          "portability: a strap is fixed to one end\n"
          '["indoor", "portability"]')
REASONED = ("outdoor - grass and a fence around it\n"
            "durability - drops of rain on the cloth\n"
            "Category: Speaker\nModel: KT-40\n"
            "Description: A round speaker on wet grass.\n"
            "Specs: 12 W, rain proof\n"
            '["outdoor", "durability"]')


def test_reasons(spark):
    got = each(spark, [
        ANSWER, "- gaming - a pad lies next to it\n2. comfort - soft rims",
        "usage scene: indoor - a brass lamp is on",
        "colour - sand - or clay - at dusk",
        '["top"]', "Now to the picture.", "", None,
        "top - first...\r\ntop - second\ntop: third", "• top – a b ", "Top  Of - x", "top - " + "y" * 300,
        "  [ top - no", "abc -no space"], lambda t: answers.reasons(t, allowed_tags()))
    assert got[0] == {"indoor": "a lamp stands behind it", "portability": "a strap is fixed to one end"}
    assert got[1] == {"gaming": "a pad lies next to it", "comfort": "soft rims"}
    assert got[2]["indoor"] == "a brass lamp is on" and got[2]["usage scene"].startswith("indoor")
    assert list(got[3]) == ["colour"]
    assert got[4:8] == [{}, {}, {}, {}]
    assert got[8] == {"top": "first"}
    assert got[9] == {"top": "a b"}
    assert got[10] == {"top of": "x"}
    assert got[11] == {"top": "y" * 300}
    assert got[12:] == [{}, {}]
    assert one(spark, "top - " + "y" * 300, lambda t: answers.reasons(t, allowed_tags(), chars=200)) == {"top": "y" * 200}


def test_details_and_prediction(spark):
    whole = one(spark, REASONED, lambda t: answers.prediction(t, allowed_tags()))
    assert whole["tags"] == ["outdoor", "durability"]
    assert (whole["category"], whole["product"]) == ("Speaker", "KT-40")
    assert whole["description"].startswith("A round speaker")
    assert whole["specs"] == "12 W, rain proof"
    assert set(whole["reasons"]) == {"outdoor", "durability"}
    long = "Specs: " + "w" * 400
    assert one(spark, long, answers.details)["specs"] == "w" * 400
    assert one(spark, long, lambda t: answers.details(t, chars=300))["specs"] == "w" * 300
    got = each(spark, ["Model: n/a\nSpecs: none\nCategory: TV", "**Category:** Mobile", '["top"]',
                       "MODEL: a\nmodel: b", "Model: None.\nModel: x"], answers.details)
    assert (got[0]["category"], got[0]["model"], got[0]["specs"]) == ("TV", None, None)
    assert got[1]["category"] == "Mobile"
    assert all(v is None for v in got[2])
    assert got[3]["model"] == "a" and got[4]["model"] == "x"
    broken = one(spark, "[oops", lambda t: answers.prediction(t, allowed_tags()))
    assert broken["tags"] == [] and broken["reasons"] == {} and broken["specs"] == ""


def test_media_type_and_base64(spark):
    given = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"RIFF____WEBP", b"GIF89a", b"GIF87a", b"RIFF____WAVE", b"not", b""]
    assert each(spark, given, images.media_type, "v binary") == [
        "image/png", "image/jpeg", "image/webp", "image/gif", "image/gif", "image/jpeg", "image/jpeg", "image/jpeg"]
    long = bytes(range(256)) * 4
    assert one(spark, long, images.base64_text, "v binary") == base64.b64encode(long).decode()


def expected_key(b64, model, context, examples=(), extra=""):
    h = hashlib.sha256(b64.encode() + b"\0" + model.encode() + b"\0" + (context or "").encode())
    for e_b64, e_tags in examples:
        h.update(b"\0" + hashlib.sha256(e_b64.encode()).digest() + b"\0" + json.dumps(sorted(e_tags)).encode())
    if extra:
        h.update(b"\0" + extra.encode())
    return h.hexdigest()


@pytest.mark.parametrize("args", [
    ("b64data", "model-1", "Category: TV"), ("other", "model-1", "Category: TV"), ("b64data", "m2", None),
    ("b64data", "model-1", "Category: TV", [("x", ["top", "colour"]), ("y", ['a "quoted" \\ one', "caf\u00e9 \U0001f600\n\x01\x7f"])]),
    ("b64data", "model-1", "Category: TV", [], "enrich")])
def test_request_key(spark, args):
    b64, model, context, *rest = args
    examples, extra = (rest + [[], ""])[:2] if len(rest) < 2 else rest
    constant = images.examples_part(examples) or None
    key = lambda e: lambda c: images.request_key(c, F.lit(model), F.lit(context), e, extra)
    assert one(spark, b64, key(constant)) == expected_key(b64, model, context, examples, extra)
    if examples:
        column = images.examples_key(F.array(*[
            F.struct(F.lit(e).alias("content_b64"), F.array(*map(F.lit, t)).alias("tags")) for e, t in examples]))
        assert one(spark, b64, key(column)) == expected_key(b64, model, context, examples, extra)


def test_validation(spark):
    raw = ["Battery  Life", "velvet harbour", "CALL QUALITY", "battery life"]
    schema = "v array<string>"
    assert one(spark, raw, lambda r: tags.kept_tags(r, allowed_tags()), schema) == ["battery life", "call quality"]
    assert one(spark, raw, lambda r: tags.dropped_tags(r, allowed_tags()), schema) == ["velvet harbour"]
    assert one(spark, ["feature graphics: camera"], lambda r: tags.kept_tags(r, allowed_tags()), schema) == []
    assert one(spark, ["feature graphics", "Camera", "front angle", "camera"],
               lambda r: tags.highlights(r, family()), schema) == ["Camera", "camera"]


def test_weak_and_feedback(spark):
    rows = spark.createDataFrame([
        (0, ["colour"], []), (1, ["colour"], ["velvet", "harbour hum"]), (2, [], []), (3, ["a"], ["b"]),
        (4, [], [f"t{i}" for i in range(10)])], "i int, kept array<string>, dropped array<string>")
    got = rows.orderBy("i").select(tags.looks_weak(F.col("kept"), F.col("dropped")).alias("weak"),
                                   tags.feedback(F.col("dropped"), F.col("kept")).alias("say")).collect()
    assert [r["weak"] for r in got] == [False, True, True, False, True]
    assert "'velvet', 'harbour hum'" in got[1]["say"] and "colour" not in got[1]["say"]
    assert "at least one" in got[2]["say"] and "'t9'" in got[4]["say"]
    short = rows.filter("i = 4").select(tags.feedback(F.col("dropped"), F.col("kept"), most=8)).first()[0]
    assert "'t7'" in short and "'t8'" not in short


def test_jaccard_and_sets(spark):
    rows = spark.createDataFrame([(0, ["a", "b"], ["b", "a"]), (1, ["a", "b"], ["a"]), (2, ["a"], ["b"]), (3, [], [])],
                                 "i int, a array<string>, b array<string>").orderBy("i")
    assert [r[0] for r in rows.select(tags.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0, 1.0]
    assert [r[0] for r in rows.select(tags.same_set(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_confidence(spark):
    rows = spark.createDataFrame([
        (0, ["a", "b"], {"a": "x", "b": "y"}, 1), (1, ["a", "b"], {"a": "x"}, 1), (2, ["a", "b"], {}, 1),
        (3, ["a"], {}, 2), (4, [], {}, 2), (5, ["a"], {"z": "x"}, None), (6, None, None, None)],
        "i int, tags array<string>, why map<string,string>, attempts int").orderBy("i")
    got = [tuple(r[0]) for r in rows.select(tags.confidence(F.col("tags"), F.col("why"), F.col("attempts"))).collect()]
    assert got == [
        ("High", "clean first answer, every tag explained"), ("Medium", "some tags unexplained"),
        ("High", "clean first answer, every tag explained"), ("Needs a look", "re-prompted, only one tag"),
        ("Needs a look", "nothing was tagged"), ("Needs a look", "some tags unexplained, only one tag"),
        ("Needs a look", "nothing was tagged")]


def test_transient(spark):
    rows = spark.createDataFrame([(0, 503, None), (1, None, "RateLimitError"), (2, 400, "RateLimitError"),
                                  (3, None, "ValueError"), (4, 429, None), (5, None, None)], "i int, s int, t string")
    got = rows.orderBy("i").select(tags.is_transient(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, True, False]


def test_headers():
    assert recognise(["Shot name", "Categories", "Model no.", "Impressions", "Unit price"]) == {
        "Shot name": "file", "Categories": "category", "Model no.": "product", "Impressions": "views", "Unit price": "price"}
    assert recognise(["FILE", "product", "PRICE/EUR", "viewed"]) == {
        "FILE": "file", "product": "product", "PRICE/EUR": "price", "viewed": "views"}
    assert recognise(["stock", "colour"]) == {}
    assert recognise(["Model", "Product Name"]) == {"Model": "product", "Product Name": "file"}


def test_prompt(spark):
    said = one(spark, "Category: TV", lambda c: prompt(c, F.lit("look again"), with_reasons=True))
    assert "Product context: Category: TV." in said and said.endswith("look again")
    assert "- usage scene: indoor, outdoor, transport" in said
    assert "Product context" not in one(spark, "", lambda c: prompt(c, F.lit(None).cast("string")))


def test_run_id(spark):
    assert one(spark, "2026-01-02 03:04:05", lambda t: text.run_id(t.cast("timestamp"))) == "20260102-030405"


def test_rules_only_name_vocabulary_terms():
    assert set(fixed.EVIDENCE_RULES) <= set(allowed_tags())


def test_prediction_of_some_fields(spark):
    from tagspark.functions.answers import FIELDS, prediction

    df = spark.createDataFrame([("colour - red: warm\nModel: X1.\n[\"colour\", \"red\"]",), (None,)], "text string")
    whole = df.select(prediction(F.col("text"), ["colour", "red"]).alias("p")).select("p.*")
    assert whole.columns == list(FIELDS)
    for fields in (["tags"], ["specs", "product"], ["reasons", "tags"]):
        some = df.select(prediction(F.col("text"), ["colour", "red"], fields).alias("p")).select("p.*")
        assert some.columns == fields and some.collect() == whole.select(*fields).collect()


def test_tags_alone_read_no_lines(spark, folder):
    from tagspark.catalog.text_queries import parse_answers

    for name, columns in (("part", "1L AS p_partkey, 'red bolt' AS p_name, 'B' AS p_brand, 'SMALL' AS p_type"),
                          ("conversations", "1L AS conv_id, 1L AS turn, 'assistant' AS role, 'none' AS text")):
        spark.sql(f"SELECT {columns}").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    plan = parse_answers(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "category|model" not in plan and "split(" not in plan.replace("split(p_name", "")
