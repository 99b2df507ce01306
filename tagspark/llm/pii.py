"""Personal data in texts by bootstrapped contextual extraction. DataFrame functions only.

1. Patterns of fixed form find the seed entities (e-mail and IP addresses, card and phone numbers) with their places.
2. Each seed induces a lexical pattern, the word in front of it. The other fillers
   of a pattern are tokens with at least `DIGITS` digits that are no part of a seed.
3. Patterns and instances form a graph that is scored in turns: a pattern by the
   mean confidence of its distinct instances, an unseen instance by the mean
   confidence of its patterns. Seeds stay at 1; patterns with fewer than `SUPPORT` distinct seeds at 0.
4. Unseen instances in patterns, both of confidence `ACCEPT` or more, are further
   identifiers; their spans have the kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark.llm.common import row_key
from tagspark.session import written

# The base rules, in a form that reads every character a bounded number of times however long a run is:
# a match starts where a run does, or where the match before has ended, and gives nothing back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
DIGITS = 5
SUPPORT = 3
ACCEPT = 0.75
TURNS = 3
# Width of a cell in the overlap join.
CELL = 64
SPACES = " \t\n\x0b\f\r"
EDGES = "\"'`,;:!?()[]{}<>=*#&%$|.+-_/\\~^"


def _found(kind: str) -> Column:
    """The matches of a kind in the column text, each with the length of the text since the one before and the word in front.

    That word is whole, however long, and may be (or end in) the match before.
    """
    def word(i: Column) -> Column:
        before = F.concat(F.when(i > 0, F.get(kind, i - 1)).otherwise(""), F.get(f"{kind}_gaps", i))
        return F.lower(F.element_at(F.split(F.rtrim(before, F.lit(SPACES)), r"\s+", -1), -1))

    return F.transform(kind, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(f"{kind}_gaps", i)).alias("gap"), m.alias("match"), word(i).alias("word")))


def _valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (F.when(F.col("kind") == "email", True)
            .when(F.col("kind") == "ip", F.col("match").rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(F.col("kind") == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
            .when(F.col("kind") == "phone", F.length(digits).between(10, 15)))


def entities(keyed: DataFrame) -> DataFrame:
    """_row, kind, start, end, match, word of the seeds and of the tokens (kind `token`) of `keyed` (_row, text); places are code points."""
    patterns = {**PATTERNS, "token": TOKEN}
    # A cheap test decides whether a pattern can match at all.
    possible = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    matched = keyed.select("_row", "text", *[
        F.when(possible.get(k, F.lit(True)) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(p), F.lit(0)))
        .otherwise(none).alias(k) for k, p in patterns.items()])
    split = matched.select("_row", *patterns, *[F.when(F.size(k) > 0, F.split("text", p, -1)).otherwise(none).alias(f"{k}_gaps")
                                                for k, p in patterns.items()])
    rows = written(split.select("_row", F.inline(F.concat(*[_found(k) for k in patterns]))), "matches")
    before = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    return rows.select("_row", "kind", "match", "word", end.alias("end")).withColumn("start", F.col("end") - F.length("match"))


def _cells(spans: DataFrame) -> DataFrame:
    return spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))).alias("cell"))


def candidates(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """_row, start, end, instance, word of the tokens, without punctuation around them, that have enough digits and touch no seed."""
    front = F.ltrim("match", F.lit(EDGES))
    core = F.rtrim(front, F.lit(EDGES))
    trimmed = (tokens.filter(F.length(F.regexp_replace("match", "[^0-9]", "")) >= DIGITS)
               .withColumn("start", F.col("start") + F.length("match") - F.length(front))
               .withColumn("core", core).withColumn("end", F.col("start") + F.length("core"))
               .select("_row", "start", "end", F.lower("core").alias("instance"), "word"))
    covered = (_cells(trimmed.select("_row", "start", "end")).alias("t")
               .join(_cells(seeds.select("_row", "start", "end")).alias("s"), ["_row", "cell"])
               .filter("t.start < s.end AND s.start < t.end").select("_row", F.col("t.start").alias("start")).distinct())
    return trimmed.join(covered, ["_row", "start"], "left_anti")


def score_graph(edges: DataFrame, turns: int = TURNS, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Confidences of patterns (word, confidence) and instances (instance, confidence) from distinct edges (word, instance, seed)."""
    instances = edges.groupBy("instance").agg(F.max("seed").alias("confidence"))
    for _ in range(turns):
        patterns = written(
            edges.join(instances, "instance").groupBy("word")
            .agg(F.avg("confidence").alias("mean"), F.sum("seed").alias("seeds"))
            .select("word", F.when(F.col("seeds") >= support, F.col("mean")).otherwise(0.0).alias("confidence")), "patterns")
        instances = written(
            edges.join(patterns, "word").groupBy("instance").agg(F.avg("confidence").alias("mean"), F.max("seed").alias("seed"))
            .select("instance", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("mean")).alias("confidence")), "instances")
    return patterns, instances


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of `docs`: doc_id, spans (array of kind, start, end in order of start and kind), base (the seeds alone).

    Ends are exclusive. Null and empty texts have no spans. Repeated rows, and
    rows with a null id, are documents of their own. Other columns are not
    read; an empty table gives no rows.
    """
    keyed, _ = row_key(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")), "doc_id", "_row")
    found = written(entities(keyed.select("_row", "text")), "entities")
    seeds = found.filter("kind <> 'token'").filter(_valid())
    others = written(candidates(found.filter("kind = 'token'"), seeds), "candidates")
    edges = written(
        seeds.select("word", F.lower("match").alias("instance"), F.lit(1.0).alias("seed"))
        .unionByName(others.select("word", "instance", F.lit(0.0).alias("seed"))).filter("word <> ''")
        .groupBy("word", "instance").agg(F.max("seed").alias("seed")), "edges")
    patterns, instances = score_graph(edges)
    trusted = (edges.filter("seed = 0").join(patterns.filter(F.col("confidence") >= accept).select("word"), "word")
               .join(instances.filter(F.col("confidence") >= accept).select("instance"), "instance").select("word", "instance"))
    unseen = others.join(trusted, ["word", "instance"]).select("_row", "start", "end", F.lit("id").alias("kind"))

    kinds = [*PATTERNS, "id"]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int")
    spans = (seeds.select("_row", "start", "end", "kind").unionByName(unseen)
             .select("_row", F.lit(None).cast("bigint").alias("doc_id"),
                     F.struct("start", rank.alias("rank"), "end", "kind").alias("span")))
    rows = keyed.select("_row", "doc_id", F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    grouped = rows.unionByName(spans).groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("found"))
    plain = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return grouped.select("doc_id", plain.alias("spans")).withColumn("base", F.filter("spans", lambda s: s["kind"] != "id"))


def joined(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
