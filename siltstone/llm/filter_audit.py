"""Audit of how document filters interact: every order of the filters is replayed over every document."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.llm.common import skew_join, written

SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions of a text by itself: A too few words, B too many repeats, C too many capitals, D marks of markup or code."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES, -1), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats_earlier(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """``docs`` without the text and with a boolean ``out``: whether a smaller id has the same text, null as empty.

    Texts are told apart by 128 bits of hash and their length; they never leave their place. The smallest id of a text
    is found with map-side combining, and the join that brings it back lets adaptive execution split the copies of a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit("2"), text, F.length(text))}
    keyed = written(docs.withColumns(keys).drop(text_col), "audit")
    first = keyed.groupBy("__h1", "__h2").agg(F.min(id_col).alias("__first"), F.max(id_col).alias("__last")).where("__first <> __last")
    return skew_join(keyed, first, ["__h1", "__h2"], "left").withColumn(out, F.coalesce(F.col(id_col) > F.col("__first"), F.lit(False))).drop("__h1", "__h2", "__first", "__last")


def filter_orders(spark: SparkSession, letters: str) -> DataFrame:
    """(order_no INT, filter_order STRING, steps ARRAY of (step INT, bit INT)): every order of the filters; bit i is the filter letters[i]."""
    rows = [(n, "".join(order), [(k + 1, 1 << letters.index(x)) for k, x in enumerate(order)]) for n, order in enumerate(permutations(letters))]
    return spark.createDataFrame(rows, "order_no int, filter_order string, steps array<struct<step: int, bit: int>>")


def replay(flagged: DataFrame, letters: str) -> DataFrame:
    """flagged (part, flags INT, good, toxic) -> a row per (part, filter_order, step) with COUNTS and shapley.

    Bit i of ``flags`` says that the document fails the filter letters[i]. The documents are crossed with the orders (n!
    rows, 120 for five filters, broadcast), each with its n steps exploded; the first step whose filter the document
    fails removes it. Counts are combined on the map side: what is shuffled is at most a row a task for each part,
    order and step, however many documents a part has.
    """
    if len(letters) > 7:
        raise ValueError("the orders of more than seven filters are too many to replay")
    orders = filter_orders(flagged.sparkSession, letters)
    first = F.coalesce(*[F.when(F.col("flags").bitwiseAND(F.col("steps")[k]["bit"]) != 0, k + 1) for k in range(len(letters))], F.lit(len(letters) + 1))
    replayed = flagged.crossJoin(F.broadcast(orders.select("order_no", "steps"))).select("part", "flags", "good", "toxic", "order_no", first.alias("first"), F.explode("steps").alias("s"))
    step, bit, gone = F.col("s.step"), F.col("s.bit"), F.col("first") == F.col("s.step")
    sums = replayed.groupBy("part", "order_no", step.alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"), F.count_if(gone).alias("removed"), F.count_if((F.col("first") < step) & (F.col("flags").bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(F.col("flags") == bit).alias("unique_fails"), F.count_if(gone & F.col("good")).alias("good_lost"), F.count_if(gone & F.col("toxic")).alias("toxic_lost"),
    )
    named = sums.join(F.broadcast(orders.select("order_no", "filter_order")), "order_no").withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    totals = named.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return named.join(totals, ["part", "filter"]).select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, repeats: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step INT, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), the counts BIGINT.

    failures: a letter -> the condition, over the columns of ``docs``, under which a document fails that filter
    (default: ``text_failures``; a null condition is not failed). ``repeats`` names one more filter, which documents
    fail whose text a smaller id has; None leaves it out. See ``replay`` for the method.

    kept: after this step; removed: by it; redundant: failing its filter but removed earlier; unique_fails: failing
    its filter only; good_lost, toxic_lost: removed here with a row quality = 1, toxic = 1 in ``labels``; shapley: what
    the filter removes in the part, summed over all orders.

    Null text: empty. Null part: the empty string, one part with it. Null id: a document like others, but with no
    label and equal to no smaller id's text. Repeated rows: each is a document, and equal ids are not smaller.
    Several labels of one id: those of any of them count. Texts are read whole, however long. Empty table: no rows.
    Other columns of both tables are not looked at, whatever their names.
    """
    failures = dict(text_failures(F.col(text_col)) if failures is None else failures)
    letters = "".join(failures) + (repeats or "")
    flags = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())), F.lit(0))
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), flags.cast("int").alias("flags"))
    if repeats:
        flagged = repeats_earlier(flagged, "id", "text", "again").withColumn("flags", F.col("flags") + F.when(F.col("again"), 1 << len(failures)).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flagged = flagged.join(marks, flagged["id"] == marks["labelled"], "left").select("part", "flags", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return replay(flagged, letters)
