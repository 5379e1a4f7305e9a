"""Line deduplication over a corpus, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, ascii_lower, skew_join


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt from the lines that stay, plus n_lines and n_dropped (BIGINT).

    A line whose key (see ``line_key``) has at least ``min_chars`` code points and occurs in at least ``min_docs``
    different documents is dropped everywhere but in the smallest id that holds it. Other lines stay, joined by \\n.

    Keys travel as 128 bits of hash, never as text. The number of documents of a key is summed up on the map side,
    so a line that all documents share costs one row a task; the join that finds the dropped positions lets adaptive
    execution split such a key. The text itself is exchanged once, by document.

    Null or empty text: one empty line. Null id: the row is returned whole and counts for no key. Rows that repeat
    an id count as one document. A column n_lines or n_dropped of the input is replaced; other columns stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns({"__th": F.xxhash64(text), "__ln": F.split(text, "\n", -1)})
    keyed = F.transform("__ln", lambda x: line_key(x))
    hashes = F.transform(keyed, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("2"), k).alias("h2"))))
    lines = base.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), "__th", F.posexplode(hashes).alias("__pos", "h")).where("h is not null").select("__id", "__th", "__pos", "h.h1", "h.h2")
    if min_docs <= 2:  # two documents hold a key when its smallest and largest ids differ
        found = lines.groupBy("h1", "h2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
        found = found.where("__first <> __last") if min_docs == 2 else found
    else:
        found = lines.select("h1", "h2", "__id").distinct().groupBy("h1", "h2").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).where(F.col("__n") >= min_docs)
    drops = skew_join(lines, found.select("h1", "h2", "__first"), ["h1", "h2"]).where("__id > __first").groupBy("__id", "__th").agg(F.collect_list("__pos").alias("__drop"))
    joined = base.join(drops.withColumnRenamed("__th", "__dh"), (base[id_col] == drops["__id"]) & (base["__th"] == F.col("__dh")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__ln") - 1), F.coalesce("__drop", F.array().cast("array<int>")))
    text_out = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__ln", i)), "\n"))
    joined = joined.withColumn("__kept", kept)
    extra = {"n_lines": F.size("__ln").cast("long"), "n_dropped": (F.size("__ln") - F.size("__kept")).cast("long"), text_col: text_out}
    return joined.withColumns(extra).drop("__id", "__th", "__dh", "__ln", "__drop", "__kept")
