"""Homomorphic document fingerprints, with DataFrame functions only.

A document is the multiset of its paragraphs (its text cut at line feeds). Each
paragraph hashes to a vector of 536 lanes and a fingerprint is the sum of the
vectors modulo 2**32:

* 16 lanes from SHA-512 of the paragraph: equality that does not depend on the
  order of paragraphs;
* 8 groups of 64 counters and a count: a phrase falls into one group by its
  hash, and counts there for each bit set in a second 64-bit hash. From them
  ``likeness`` estimates the cosine of the phrase multisets: within a group a
  bit is a random sign, so a group's product of signed sums estimates its part
  of the dot product, with an error of about 1 / sqrt(512) of the norms.

Sums modulo a power of two form a group, so inserting or deleting paragraphs is
adding or subtracting their fingerprints, without reading the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm import common

LANES, GROUPS, COUNTERS = 16, 8, 64
MASK = (1 << 32) - 1
#: Phrases end at white space after one of these: places that depend on the text around only.
PHRASE_END = r"(?<=[\p{P}\p{S}aest])[^\S\n]+"
#: Eight 8-bit counters in a long; at most BLOCK phrases are added before they are unpacked.
EIGHT, BLOCK = 0x0101010101010101, 127


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column) -> Column:
    """array<bigint> of 16 hash lanes, then per group 64 counters and the number of phrases. Null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    zero = F.lit(0).cast("long")
    lanes = F.aggregate(
        F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 512)),
        F.array(*[zero] * LANES),
        lambda acc, h: F.array(*[(F.element_at(acc, k + 1) + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")).bitwiseAND(MASK) for k in range(LANES)]),
    )
    # the phrases of each paragraph; a phrase does not reach over a line feed
    hashes = F.transform(F.split(text, r"\n|" + PHRASE_END, -1), lambda p: F.xxhash64(p))
    packed = F.struct(*[zero.alias(f"w{k}") for k in range(8)])

    def step(acc: Column, h: Column) -> Column:
        return F.struct(*[(acc[f"w{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(EIGHT)).alias(f"w{k}") for k in range(8)])

    def unpack(acc: Column) -> Column:
        return F.array(*[F.shiftrightunsigned(acc[f"w{k}"], 8 * b).bitwiseAND(255) for k in range(8) for b in range(8)])

    def counted(all_of: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / BLOCK).cast("int"))
        sums = F.aggregate(
            blocks, F.array_repeat(zero, COUNTERS),
            lambda acc, i: F.zip_with(acc, F.aggregate(F.slice(all_of, i * BLOCK + 1, BLOCK), packed, step, unpack), lambda p, q: (p + q).bitwiseAND(MASK)),
        )
        return F.concat(sums, F.array(F.size(all_of).cast("long")))

    def grouped(all_of: Column) -> Column:
        own = lambda g: F.filter(all_of, lambda h: F.shiftrightunsigned(h, 61) == g)  # noqa: E731  a hash's first three bits
        empty = F.array_repeat(zero, COUNTERS + 1)
        signs = lambda hs: F.when(F.size(hs) == 0, empty).otherwise(_bind(F.transform(hs, lambda h: F.xxhash64(h)), counted))
        return F.flatten(F.transform(F.sequence(zero, F.lit(GROUPS - 1).cast("long")), lambda g: _bind(own(g), signs)))

    return F.concat(lanes, _bind(hashes, grouped))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or with sign -1 of a without b."""
    return F.zip_with(a, b, lambda p, q: (p + sign * q).bitwiseAND(MASK))


def text_form(fp: Column) -> Column:
    """The hash lanes as lowercase hex, eight digits each: equal for equal multisets of paragraphs, which fix the counters too."""
    return F.lower(F.array_join(F.transform(F.slice(fp, 1, LANES), lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, else the estimated cosine of the phrase counts, not below 0."""

    def cosine(p: Column) -> Column:
        def signed(fp: Column) -> Column:  # per group and bit, how many more phrases have it set than not
            group = lambda g: F.slice(fp, LANES + 1 + g * (COUNTERS + 1), COUNTERS)
            count = lambda g: F.element_at(fp, LANES + (g + 1) * (COUNTERS + 1))
            parts = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: _bind(count(g), lambda n: F.transform(group(g), lambda c: (2 * c - n).cast("double"))))
            return F.flatten(parts)

        def of(q: Column) -> Column:
            three = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
            add = lambda s, e: F.struct((s["dot"] + e["x"] * e["y"]).alias("dot"), (s["x"] + e["x"] * e["x"]).alias("x"), (s["y"] + e["y"] * e["y"]).alias("y"))
            end = lambda s: F.when(s["x"] * s["y"] > 0, s["dot"] / F.sqrt(s["x"] * s["y"])).otherwise(0.0)
            return F.aggregate(F.arrays_zip(q["x"], q["y"]), three, add, end)

        return _bind(F.struct(signed(p["a"]).alias("x"), signed(p["b"]).alias("y")), of)

    same = F.slice(a, 1, LANES) == F.slice(b, 1, LANES)
    found = _bind(F.struct(a.alias("a"), b.alias("b")), cosine)
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def _range_of(key: Column, bounds: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many bounds are at or below the key, as a binary tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < bounds[middle], _range_of(key, bounds, low, middle)).otherwise(_range_of(key, bounds, middle + 1, high))


def with_next(rows: DataFrame, key: str, derived: dict[str, Column], most: int = 2000) -> DataFrame:
    """``rows`` with the derived columns and next_<column> for text and these, from the following row by key, then text; after the last comes the first.

    Rows are dealt by ranges of the key (quantiles, four for each shuffle
    partition and ``most`` at most). Each range also gets a copy of the rows
    that begin the next one, so a window inside each range is enough and no
    task sees the whole order. Derived columns are made once a row, after the
    rows are dealt and sorted. Null keys come first.
    """
    spark = rows.sparkSession
    parts = min(most, 4 * common.partitions(spark))
    keyed = rows.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    share = [k / parts for k in range(1, parts)]
    found = keyed.select(F.percentile_approx("_k", share, 10 * parts)).first()[0]
    keyed = keyed.withColumn("_p", _range_of(F.col("_k"), sorted(set(found or []))))
    begins = sorted((r[0], r[1]) for r in keyed.groupBy("_p").agg(F.min("_k")).collect())  # a row for each range
    table = [(k, begins[i - 1][0]) for i, (_, k) in enumerate(begins)]
    table = spark.createDataFrame(table, "_k long, _before int")
    here = F.struct(F.col("_p").alias("p"), F.lit(0).alias("copy"))
    there = F.struct(F.col("_before").alias("p"), F.lit(1).alias("copy"))
    spread = keyed.join(F.broadcast(table), "_k", "left").withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    spread = spread.select(*rows.columns, "_k", F.col("_to.p").alias("_p"), F.col("_to.copy").alias("_copy"))
    spread = spread.repartition("_p").sortWithinPartitions("_p", "_copy", "_k", "text").withColumns(derived)
    order = Window.partitionBy("_p").orderBy("_copy", "_k", "text")
    return spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *derived)]).where("_copy = 0").drop("_k", "_p", "_copy")


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts.

    The edited text has the last floor(n / 4) of n code points replaced by the
    first as many (or all) of the next document, by ascending id (after the last: the first).
    Its fingerprint comes from the document's by deleting the paragraphs that
    the edit touches and inserting the new ones.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts are empty. Ties of ids are ordered by
    text, null ids first; repeated rows follow each other. A single row is its
    own next one. Other columns, of any name, are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    both = with_next(rows, "id", {"fp": fingerprint(F.col("text"))})
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    both = both.withColumn("n", n).withColumn("head", F.substring(F.col("text"), F.lit(1), kept))
    both = both.withColumn("edited", F.concat("head", F.substring(F.col("next_text"), F.lit(1), F.col("n") - F.length("head"))))
    # whole paragraphs before the cut stay; the rest is deleted and inserted
    stable = F.length("head") - F.length(F.substring_index("head", "\n", -1))
    rest = lambda c: F.substring(c, stable + 1, F.length(c))
    both = both.withColumn("old", fingerprint(rest(F.col("text")))).withColumn("new", fingerprint(rest(F.col("edited"))))
    both = both.withColumn("edited_fp", combine(combine(F.col("fp"), F.col("old"), -1), F.col("new")))
    return both.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
