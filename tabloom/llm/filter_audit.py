"""Filter interaction audit: what each filter removes at each step of every order.

Filters are conditions on a document; where one holds, the document fails it. A
document's failures are the bits of a mask, and all that the audit asks follows
from how many documents of a part have each mask. So texts are read once, into
narrow rows, and these are counted into mask cells, at most 2^filters for each
part. The cells are unpivoted against all steps of all orders; a running bit-or
over a cell's steps tells which of its failures came earlier; conditional sums
over the cells of a step give its counts, and a window over all steps of a
filter gives its total over the orders.

Copies are found over the whole table by a 256-bit digest of the text: each
digest's least id is aggregated, and rows look themselves up by digest and id
together, so a large group of copies meets in no task. Rows equal in everything
are counted together first.

Defined results: a null text is empty; a null source is the part named by the
empty text, together with sources that are empty; a null doc_id is no copy, makes
none and has no labels; rows of one id and text are not copies of each other
(no id is smaller), rows of one id and unlike texts count one by one; where labels
has several rows of an id, one with the mark is enough, and null marks are none; an
empty table has no parts, and so no rows. Other columns of both tables are not
read. There are n! * n steps for n filters, so at most seven filters are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.common import Store

WORDS = r"[\x20\x09-\x0D]+"
#: The filter of copies, among the letters of ``FAILS``.
COPIES = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORDS), "")


#: Letter of each filter and its condition on the text and its words; the copies' is made by ``audit``.
FAILS: dict[str, Callable[[Column, Column], Column] | None] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
    COPIES: None,
}


def cells(docs: DataFrame, labels: DataFrame, fails: dict[str, Callable[[Column, Column], Column] | None] = FAILS) -> DataFrame:
    """part, mask, and how many documents have that mask in that part: docs, good, toxic."""
    bits = {letter: 1 << i for i, letter in enumerate(fails)}
    store = Store(docs.sparkSession, "filter-audit")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), _words(text).alias("words"))
    own = [F.when(make(F.col("text"), F.col("words")), bits[letter]).otherwise(0) for letter, make in fails.items() if make]
    mask = sum(own, F.lit(0))
    rows = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id", "part", mask.alias("mask"))
    rows = store.keep(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("docs")), "rows")
    if COPIES in fails:
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
        copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
        rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, bits[COPIES]).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    # rows without an id find no labels; a number of their own keeps them from meeting in one task
    rows = rows.withColumn("lone", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    rows = rows.join(marks.withColumn("lone", F.lit(0).cast("long")), ["doc_id", "lone"], "left")
    count = lambda c: F.sum(F.when(F.col(c) == 1, F.col("docs")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(count("good"), count("toxic"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Callable[[Column, Column], Column] | None] = FAILS) -> DataFrame:
    """A row for each part, filter_order and step, with what the step's filter does there.

    ``docs``: doc_id, source, text. ``labels``: doc_id, quality, toxic. ``fails``
    names each filter by a letter; the one of copies has no condition of its own.
    """
    letters = "".join(fails)
    if not 0 < len(fails) <= 7 or len(letters) != len(fails):
        raise ValueError("one to seven filters, each named by one letter")
    orders = ["".join(p) for p in permutations(letters)]
    steps = cells(docs, labels, fails).withColumn("filter_order", F.explode(F.lit(orders)))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("step", "filter")).withColumn("step", F.col("step") + 1)
    bit = F.expr("shiftleft(1, cast(locate(filter, '" + letters + "') - 1 as int))")
    steps = steps.withColumn("bit", bit).withColumn("own", F.col("mask").bitwiseAND(F.col("bit")))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    count = lambda when, of="docs": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    new, fresh = (F.col("own") != 0) & (F.col("earlier") == 0), (F.col("own") == 0) & (F.col("earlier") == 0)
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        count(fresh).alias("kept"),
        count(new).alias("removed"),
        count((F.col("own") != 0) & (F.col("earlier") != 0)).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(new, "good").alias("good_lost"),
        count(new, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter"))).withColumn("step", F.col("step").cast("int"))
