"""Personal data by fixed forms, and by contexts that are learned from the entities found.

Entities of the fixed forms are the seeds. A seed's lexical patterns are the word before it and the
word after it, each with the shape of the entity. Patterns and the values they surround make a
graph: a pattern is as sure as the mean score of its values, a value as sure as its sure patterns
allow together. After a few rounds, sure patterns give up the values that no fixed form has found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import SPACE, WORD, kept_table

#: Kinds in the order of results, and the forms of their matches. Possessive
#: quantifiers and look-behinds change no match; they keep the search linear in the text.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TOKEN = rf"(?<!{WORD[:-1]})[^\x20\x09-\x0D0-9]*+[0-9]{WORD[:-1]}*+"
#: Characters of context on either side, from which the neighbouring words are taken.
CONTEXT = 80
ROUNDS = 3
LEAST_SEEDS = 3
SURE_PATTERN = 0.8
SURE_VALUE = 0.9


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, from the gaps between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def further(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gaps"])
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gaps"), found.alias("found"))
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, begin, further)["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The Luhn sum of the digits is a multiple of ten."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    counted = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(counted, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return n.between(16, 19) & _luhn(value)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _inner(token: Column) -> Column:
    """A token without the marks around it, with its place inside the token."""
    lead = F.length(F.regexp_extract(token["value"], r"^[\"'(\[<{]*", 0))
    value = F.regexp_extract(token["value"], r"^[\"'(\[<{]*+(.*?)[\"')\]>}.,;:!?]*$", 1)
    return F.struct((token["start"] + lead).alias("start"), (token["start"] + lead + F.length(value)).alias("end"), value.alias("value"))


def found_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, email, ip, card, phone, others): spans of each kind, and other tokens with digits, with their contexts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), text.alias("body"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    some_digit = F.col("body").rlike("[0-9]")

    def worth(kind: str) -> Column:
        need = F.col("body").contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        return need if kind == "email" else need & some_digit

    def held(kind: str) -> Column:
        return F.when(worth(kind), F.filter(spans(F.col("body"), FORMS[kind]), lambda s: _holds(kind, s["value"]))).otherwise(empty)

    rows = rows.withColumns({k: held(k) for k in FORMS})
    tokens = F.when(some_digit, F.transform(spans(F.col("body"), TOKEN), _inner)).otherwise(empty)
    rows = rows.withColumn("tokens", tokens)
    every = F.concat(*FORMS)
    apart = lambda t: ~F.exists(every, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    rows = rows.withColumn("others", F.filter("tokens", lambda t: (t["end"] > t["start"]) & apart(t)))

    def in_context(s: Column) -> Column:
        before = F.substring(F.col("body"), F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(s["start"], F.lit(CONTEXT)))
        after = F.substring(F.col("body"), s["end"] + 1, F.lit(CONTEXT))
        left = F.lower(F.regexp_extract(before, rf"({WORD}){SPACE}*[\"'(\[<{{]*$", 1))
        right = F.lower(F.regexp_extract(after, rf"^[\"')\]>}}.,;:!?]*{SPACE}+({WORD})", 1))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), left.alias("left"), right.alias("right"))

    return rows.select("doc_id", "mark", *[F.transform(k, in_context).alias(k) for k in [*FORMS, "others"]])


def shape(value: Column) -> Column:
    """Letters become a, digits 9, runs are cut to one sign, and to two from six characters on."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\p{L}{6,}", "AA"), r"\p{L}+", "a")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[0-9]{6,}", "NN"), "[0-9]+", "9"), "NN", "99")


def _edges(entities: DataFrame) -> DataFrame:
    """(value, form, kind, side, word): distinct edges of values and patterns; kind is null for values of no fixed form."""
    each = reduce(DataFrame.unionByName, [
        entities.select(F.lit(k if k in FORMS else None).cast("string").alias("kind"), F.explode(k).alias("e")) for k in [*FORMS, "others"]])
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("e.left").alias("word")), F.struct(F.lit("right").alias("side"), F.col("e.right").alias("word"))))
    return each.select(F.col("e.value").alias("value"), shape(F.col("e.value")).alias("form"), "kind", sides.alias("s")).select("value", "form", "kind", "s.*").where("word <> ''").distinct()


def discovered(entities: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, form, kind, score): values of no fixed form that sure patterns surround.

    A pattern needs LEAST_SEEDS seeds. Its score is the mean score of its distinct values; a value
    that is no seed scores 1 less the product of what its sure patterns leave open. The kind is
    that of most seeds of its surest pattern. Without seeds nothing is found.
    """
    edges = kept_table(_edges(entities), "edges")
    seeds = edges.where("kind is not null").groupBy("side", "word", "form").agg(F.countDistinct("value").alias("seeds"), F.mode("kind", True).alias("pattern_kind")).where(F.col("seeds") >= LEAST_SEEDS)
    edges = kept_table(edges.join(seeds, ["side", "word", "form"]), "edges")
    scores = None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
        if scores is not None:
            scored = edges.join(scores.select("value", "form", "score"), ["value", "form"], "left").withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        sure = scored.groupBy("side", "word", "form").agg(F.avg("score").alias("pattern_score")).where(F.col("pattern_score") >= SURE_PATTERN)
        open_to = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("pattern_score"))))
        scores = kept_table(
            edges.where("kind is null").join(sure, ["side", "word", "form"]).groupBy("value", "form")
            .agg((1 - F.exp(open_to)).alias("score"), F.max_by("pattern_kind", F.struct("pattern_score", "pattern_kind")).alias("kind")), "scores")
    return scores.where(F.col("score") >= SURE_VALUE)


def _listed(entities: Column) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in FORMS]), e["kind"]), e["start"], e["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts and the digest are those of the fixed forms; spans lists them and the discovered
    ones, by kind, then start. A null text counts as empty. Repeated rows give a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    entities = kept_table(found_entities(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "entities")
    more = discovered(entities)
    others = entities.where(F.size("others") > 0).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("of"), F.col("mark").alias("of_mark"), F.explode("others").alias("e"))
    number = F.array_position(F.array(*[F.lit(k) for k in FORMS]), F.col("kind")).cast("int") - 1
    added = (others.withColumn("value", F.col("e.value")).withColumn("form", shape(F.col("e.value"))).join(more, ["value", "form"])
             .groupBy("of", "of_mark").agg(F.collect_set(F.struct(number.alias("kind"), F.col("e.start").alias("start"), F.col("e.end").alias("end"))).alias("added")))
    rows = entities.join(added, (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    numbered = lambda i, k: F.transform(k, lambda e: F.struct(F.lit(i).alias("kind"), e["start"].alias("start"), e["end"].alias("end")))
    base = F.concat(*[numbered(i, k) for i, k in enumerate(FORMS)])
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    rows = rows.withColumn("base", base).withColumn("whole", F.array_sort(F.concat(F.col("base"), F.coalesce("added", nothing))))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("whole")).alias("spans"))
