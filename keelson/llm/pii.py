"""Personal data: base patterns, and terms that disclose them by co-occurrence. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of one pattern per kind
that pass that kind's test. Positions come from the text cut at the matches:
gaps and matches alternate, so running sums of their lengths are the offsets.

Information-theoretic sanitisation: the value of each base span (a certain
address, a certain number) is a protected entity, and every one is scored. A term of a text that holds
the entity reveals it by its pointwise mutual information relative to the entity's information content:

    log2(p(t, e) / (p(t) p(e))) / -log2 p(e)

with probabilities over all distinct texts; copies of one text are one
observation. ``smooth`` is added to the texts of the term, as if that much of a text had held it
without the entity, so the score nears 1 where the term occurs with the entity
only and often, and falls with little evidence; no count is asked for. Terms at ``disclosure`` or more
get spans of kind term wherever they occur in a text that holds the entity,
except inside base spans.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in a form whose matching time is linear: possessive, and only from places where a match can begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to match at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: A whole run of letters and digits, two at least, with a letter in it.
TERM = r"(?<![\p{L}\p{N}])(?=\p{N}*+\p{L})[\p{L}\p{N}]{2,}+"


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _typed(k: int, m: Column) -> Column:
    return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))


def _passes(kind: str, match: Column) -> Column:
    value = match["value"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: _bind(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255")))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return _bind(_digits(value), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    return F.length(_digits(value)).between(9, 15)


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, end exclusive."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    found = F.filter(zipped, lambda x: x["value"].isNotNull())
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the base spans, by kind as listed, then start."""
    parts = []
    for k, kind in enumerate(KINDS):
        some = F.filter(matches(text, PATTERNS[kind]), partial(_passes, kind))
        typed = F.transform(some, partial(_typed, k))
        empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
        parts.append(F.when(text.rlike(NEEDS[kind]), typed).otherwise(empty))
    return F.concat(*parts)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _whole_words(words: Column) -> Column:
    """The pattern of these TERM runs."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def disclosures(docs: DataFrame, disclosure: float = 0.9, smooth: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """From rows (row, copy, text, spans), copy the same for equal texts: (row, words: its words that disclose an entity of its own; the scored pairs).

    As n_te <= n_e, a term in more than n_e**disclosure * n**(1 - disclosure) - smooth texts
    cannot reach the threshold; such terms are not paired.
    """
    some = docs.where(F.size("spans") > 0)
    value = lambda s: F.concat_ws(":", s["kind"].cast("string"), s["value"])
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
    held = common.saved(some.select("row", "copy", F.array_distinct(F.transform("spans", value)).alias("entities"), words.alias("words")), "held")
    known, n = _known(docs)
    one = held.select("row", "copy", F.explode("entities").alias("entity"))
    entities = common.saved(one.groupBy("entity").agg(F.count_distinct("copy").alias("n_e")), "entities")
    most = one.join(entities, "entity").groupBy("row").agg(F.max("n_e").alias("most"))
    terms = held.select("row", F.explode("words").alias("word")).withColumn("term", F.lower("word")).join(known, "term").join(most, "row")
    bound = F.pow(F.col("most"), F.lit(disclosure)) * F.pow(F.lit(float(n)), F.lit(1 - disclosure)) * 1.000001
    rare = common.saved(terms.where(F.col("n_t") + smooth <= bound).drop("most"), "rare")
    mentions = one.distinct().join(rare.distinct(), "row")
    scored = mentions.groupBy("entity", "term", "n_t").agg(F.count_distinct("copy").alias("n_te")).join(entities, "entity")
    scored = scored.withColumn("content", -F.log2(F.col("n_e") / F.lit(n)))
    scored = scored.withColumn("pmi", F.log2(F.col("n_te") * F.lit(float(n)) / ((F.col("n_t") + F.lit(smooth)) * F.col("n_e"))))
    scored = common.saved(scored.withColumn("disclosed", F.when(F.col("content") > 0, F.col("pmi") / F.col("content")).otherwise(0.0)), "pairs")
    revealing = scored.where(F.col("disclosed") >= disclosure).select("entity", "term")
    return mentions.join(revealing, ["entity", "term"]).groupBy("row").agg(F.array_sort(F.collect_set("word")).alias("words")), scored


def _known(docs: DataFrame) -> tuple[DataFrame, int]:
    """((term, n_t): in how many distinct texts each term stands, the number of distinct texts)."""
    apart = docs.groupBy("copy", "row").count().groupBy("copy").agg(F.sum("count").alias("all"), F.min("row").alias("first"), F.min_by("count", "row").alias("same"))
    apart = common.saved(apart, "copies")
    many = apart.where("all > 1")
    one = docs.select("copy", "row", "text").join(common.broadcast_if_small(many, many.count()), "copy", "left").where("first is null or row = first")
    lower = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    words = one.select(F.when(F.col("same") > 1, F.col("copy")).alias("repeated"), F.explode(lower).alias("term"))
    counts = words.groupBy("term", "repeated").agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.sum(F.when(F.col("repeated").isNull(), F.col("n")).otherwise(1)).alias("n_t")), apart.count()


def _searched(docs: DataFrame, id_col: str, text_col: str, disclosure: float, smooth: float) -> DataFrame:
    """(own struct of all columns, base, spans) of every row."""
    rows = docs.select(F.struct(*docs.columns).alias("own"), F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("found", base_spans(F.col("text"))).withColumn("row", F.xxhash64("id", "text"))
    terms, _ = disclosures(rows.select("row", F.xxhash64("text").alias("copy"), "text", F.col("found").alias("spans")), disclosure, smooth)
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = slim(F.col("found"))
    more = F.transform(matches(F.col("text"), _whole_words(F.col("words"))), lambda m: F.struct(F.lit(4).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    apart = F.filter(more, lambda t: ~F.exists(F.col("found"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.when(F.col("words").isNull(), base).otherwise(F.concat(base, apart))
    # only texts with an entity meet the terms; the others, most of them, are not shuffled
    some = rows.where(F.size("found") > 0).join(terms, "row", "left").select("own", F.col("found").alias("base"), spans.alias("spans"))
    empty = [F.array().cast(some.schema[c].dataType).alias(c) for c in ("base", "spans")]
    return rows.where(F.size("found") == 0).select("own", *empty).union(some)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.9, smooth: float = 0.5) -> DataFrame:
    """``docs`` with base array<struct<kind, start, end, value>> and spans (base spans and terms, kind 4).

    Every row is searched by its whole text; a null text counts as empty and
    has no spans. Repeated rows give repeated results; equal texts are one
    observation. Other columns stay as they are, of any name; base and spans of
    the input give way to the new ones. An empty table gives an empty result.
    """
    found = _searched(docs, id_col, text_col, disclosure, smooth)
    return found.select(*[F.col("own")[c].alias(c) for c in docs.columns if c not in ("base", "spans")], "base", "spans")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, counts per kind, base_sha256, spans, n_spans: the number of all spans) of what ``find`` returns."""
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    total = F.size("spans").cast("long").alias("n_spans")
    return found.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), total)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span generalised to the name of its kind; of overlapping spans the earlier, then longer, counts."""
    marks = F.array(*[F.lit(MARKS[k]) for k in (*KINDS, "term")])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(marks, s["kind"] + 1))
        put = F.struct((-s["neg"]).alias("at"), kept.alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], -s["neg"]).alias("at"), acc["out"].alias("out"))).otherwise(put)

    done = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(done)


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.9, smooth: float = 0.5) -> DataFrame:
    """``docs`` with the spans in its texts generalised; all other columns, of any name, and rows stay."""
    found = _searched(docs, id_col, text_col, disclosure, smooth)
    own = F.col("own")
    return found.select(*[redact(own[c], F.col("spans")).alias(c) if c == text_col else own[c].alias(c) for c in docs.columns])
