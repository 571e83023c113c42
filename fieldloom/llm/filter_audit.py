"""Filter interaction audit: what every order of a set of filters removes, from one histogram.

Each document gets a mask with a bit for each filter that it fails, by native expressions over its
whole text; the filter of exact copies takes the smallest doc_id of each text from a groupBy on
the text.  Documents are then counted by part and mask, so a part has at most 2**5 cells, and all
orders are read off the cells: in an order, a cell's documents go at the first filter of theirs.

The groupBy moves a SHA-256 of the text, not the text.  Its smallest ids are joined back to
rows of some forty bytes; only texts that stand twice are in that table, and Spark may split the rows
of a text with many copies.  The counts by cell are partial sums before they move.

Edge cases: a null text is empty (no words, shares or symbols: it fails only the filter of short
texts, and that of copies if another empty text has a smaller doc_id); a text of any length is
read whole; equal rows are counted each, and as neither's doc_id is smaller neither is a copy of
the other; a row without doc_id is no copy, makes no copies and has no labels; a null part is the
empty string; labels that are null or repeated count once, if any of them is 1; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import string
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.quality import let, words

#: Bits of the mask, in this order.
FILTERS = "ABCDE"
_SYMBOLS = "#$%&*|"


def failures(text: Column, own: Column) -> list[Column]:
    """Which of the filters on the text alone it fails; ``own`` are its words."""
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return [
        F.size(own) < 200,
        let(own, lambda w: 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)),
        100 * capitals > 3 * F.length(text),
        F.regexp_like(text, F.lit(f"[{_SYMBOLS}]")),
    ]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, part)."""
    rows = docs.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", "text", words(F.col("text")).alias("own"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(F.col("text"), F.col("own")))), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("mask"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(FILTERS) - 1).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and those labelled so."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic")).where("quality + toxic > 0")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality", "good"), total("toxic", "toxic"))


def orders(found: DataFrame) -> DataFrame:
    """Every order and step over ``found`` (part, mask, n, good, toxic): what is kept, removed and lost there."""
    steps = [("".join(p), i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in p[:i])) for p in permutations(FILTERS) for i, f in enumerate(p)]
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"e":{e}}}' for o, s, b, e in steps) + "]"), "array<struct<o:string,s:int,b:int,e:int>>")
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    each = parts.select("part", "cells", F.explode(table).alias("at"))
    bit, earlier = F.col("at.b"), F.col("at.e")

    def total(which, value: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(which(c["mask"]), c[value]).otherwise(0))

    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(earlier) == 0)
    out = each.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        bit.alias("bit"),
        total(lambda m: m.bitwiseAND(bit + earlier) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter order and step: counts of ``docs`` (doc_id, text, part), by ``labels`` (doc_id, quality, toxic)."""
    return orders(cells(masks(docs), labels))
