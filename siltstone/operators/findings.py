"""The finding pipeline: merge, score, rank, threshold, persist."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siltstone.checkpoints import written
from siltstone.functions.dims import at_least, is_ai, normalise_rule, severity_rank, severity_weight, source_confidence
from siltstone.functions.text import code_tokens, fingerprint, text_similarity

LINE_SLACK, TITLE_SIMILARITY = 4, 0.55


def concatenate(*streams: DataFrame) -> DataFrame:
    """All findings of all producers; fields that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col("file_path"), F.col("category"), F.col("rule_id"), F.col("title"), F.col("start_line")))


def lines_overlap(a: str, b: str, slack: int = LINE_SLACK) -> Column:
    """Whether the intervals of aliases a and b overlap when widened by ``slack``."""
    c = F.col
    return (c(f"{a}.start_line") - slack <= c(f"{b}.end_line")) & (c(f"{b}.start_line") - slack <= c(f"{a}.end_line"))


def same_issue(a: str, b: str) -> Column:
    """Equal fingerprints; or overlapping lines and the same rule, the same CWE, or similar titles."""
    c = F.col
    given = lambda f: (F.coalesce(c(f"{a}.{f}"), F.lit("")) != "") & (F.coalesce(c(f"{b}.{f}"), F.lit("")) != "")
    rule = given("rule_id") & (normalise_rule(c(f"{a}.rule_id")) == normalise_rule(c(f"{b}.rule_id")))
    cwe = given("cwe") & (c(f"{a}.cwe") == c(f"{b}.cwe"))
    title = text_similarity(c(f"{a}.title"), c(f"{b}.title")) >= TITLE_SIMILARITY
    return (c(f"{a}.fingerprint") == c(f"{b}.fingerprint")) | (lines_overlap(a, b) & (rule | cwe | title))


def overlap_pairs(df: DataFrame, key: str, id_col: str, start: str, end: str, slack: int = LINE_SLACK) -> DataFrame:
    """(key, a, b): ids of rows of one key, a before b, whose intervals [start - slack, end] overlap, both ways round.

    Not all pairs of a key meet. An interval is held in the bins of its own width, the power of two that is at least its
    length, of which it touches two at most, and asks there and in the bins of all larger widths that occur: a pair meets in the bins
    of the longer of the two. Of the two bins that a pair may share, the first common one counts, so a pair comes once. The rows that meet are
    those that overlap and their neighbours, however many rows a key has.

    Null keys, ids or bounds: no pair. Equal ids make no pair; a row that is repeated makes its pairs as often. An end before
    the start is an interval that still overlaps what the two comparisons say. Empty table: no rows.
    """
    low, high = F.col(start).cast("long") - slack, F.col(end).cast("long")
    rows = df.select(F.col(key).alias("key"), F.col(id_col).alias("id"), low.alias("low"), high.alias("high")).where("key is not null and id is not null and low is not null and high is not null")
    rows = rows.select("key", "id", "low", "high", F.least("low", "high").alias("left"), F.greatest("low", "high").alias("right"))
    rows = rows.withColumn("level", F.ceil(F.log2(F.col("right") - F.col("left") + 1)).cast("int"))
    levels = F.array(*(F.lit(r.level).cast("int") for r in rows.select("level").distinct().orderBy("level").collect()))  # at most 64
    first, bins = F.expr("shiftright(left, level)"), F.expr("sequence(shiftright(left, level), shiftright(right, level))")
    held = rows.select("key", "id", "low", "high", "level", first.alias("first"), F.explode(bins).alias("bin"))
    asks = rows.select("key", "id", "low", "high", "left", "right", F.col("level").alias("own"), F.explode(F.filter(levels, lambda x: x >= F.col("level"))).alias("level"))
    asks = asks.select("key", "id", "low", "high", "own", "level", first.alias("first"), F.explode(bins).alias("bin"))
    x, y = held.alias("x"), asks.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.bin") == F.col("y.bin")))
    once = (F.col("x.bin") == F.greatest("x.first", "y.first")) & ((F.col("y.own") < F.col("y.level")) & (F.col("x.id") != F.col("y.id")) | (F.col("y.own") == F.col("y.level")) & (F.col("x.id") < F.col("y.id")))
    met = met.where(once & (F.col("x.low") <= F.col("y.high")) & (F.col("y.low") <= F.col("x.high")))
    return met.select(F.col("x.key").alias(key), F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


class Leaders:
    """The first findings of clusters, looked up by what a later finding may share with them; findings come in the order of their first lines.

    A leader whose last line, with the slack, lies before the next first line is struck from a list when the list is read: no
    later finding overlaps it. Titles are looked up by their rare words: of n words, a similar title has one of any n - ceil(0.55 n) + 1.
    """

    def __init__(self, often: dict[str, int]):
        self.often, self.rows = often, []
        self.prints: dict[str, int] = {}
        self.lists: dict[tuple, list[int]] = {}

    def rare(self, words: frozenset) -> list[str]:
        return sorted(words, key=lambda t: (self.often.get(t, 0), t))[: len(words) - math.ceil(TITLE_SIMILARITY * len(words) - 1e-9) + 1]

    def names(self, r: dict) -> list[tuple]:
        words = r["__tokens"]
        return [(k, r[f]) for k, f in (("rule", "__rule"), ("cwe", "cwe")) if r[f]] + ([("word", t) for t in self.rare(words)] if words else [("empty",)])

    def add(self, r: dict) -> None:
        self.prints.setdefault(r["fingerprint"], len(self.rows))
        for name in self.names(r):
            self.lists.setdefault(name, []).append(len(self.rows))
        self.rows.append(r)

    def home(self, r: dict) -> int | None:
        """The number of the first leader that is the same issue."""
        best = self.prints.get(r["fingerprint"])
        for name in self.names(r):
            held = self.lists.get(name)
            if not held:
                continue
            if any(self.rows[i]["end_line"] < r["start_line"] - LINE_SLACK for i in held):
                held[:] = [i for i in held if self.rows[i]["end_line"] >= r["start_line"] - LINE_SLACK]
            for i in held:
                if best is not None and i >= best:
                    break
                if self.rows[i]["start_line"] - LINE_SLACK <= r["end_line"] and (name[0] != "word" or self.similar(self.rows[i]["__tokens"], r["__tokens"])):
                    best = i
                    break
        return best

    @staticmethod
    def similar(x: frozenset, y: frozenset) -> bool:
        return len(x & y) / len(x | y) >= TITLE_SIMILARITY


def islands(df: DataFrame) -> DataFrame:
    """With __island: runs of a file's and category's findings, in the order of their lines, that no issue goes across.

    A finding begins a run if it overlaps none before and lies in another ten of lines, so that it has no fingerprint of them either.
    """
    w = Window.partitionBy("file_path", "category").orderBy("start_line", F.desc("__rank"), "ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("start_line") - LINE_SLACK > F.max("end_line").over(before)) & (F.floor(F.col("start_line") / 10) != F.floor(F.lag("start_line").over(w) / 10))
    return df.withColumn("__apart", F.when(apart, 1).otherwise(0)).withColumn("__island", F.sum("__apart").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__apart")


def merge_findings(df: DataFrame, bundle: int = 20_000) -> DataFrame:
    """Findings of one issue become one, with the other tools as corroboration.

    Within a file and category, in order of first line and falling severity, a finding joins the first cluster whose
    leader is the same issue, else it leads a new one. The cluster's representative has the highest severity, then
    the longest description, then a deterministic source; it takes on the others' range, sources, related files (8 at
    most) and a confidence raised by each other source. This depends on the order, so a run of findings that overlap (see
    ``islands``) is one sweep that looks leaders up (see ``Leaders``) instead of comparing with all. A finding that is alone
    in its run stays in Spark; the other runs come to pandas in bundles, dealt by hash, of about ``bundle`` findings. Input: ord,
    file_path, category, severity, source, rule_id, cwe, title, description, start_line, end_line, confidence,
    related_files. Ties in the order go to the smaller ord.
    """
    ready = with_fingerprint(df).select(
        *df.columns, "fingerprint", severity_rank(F.col("severity")).alias("__rank"), normalise_rule(F.coalesce("rule_id", F.lit(""))).alias("__rule"),
        F.array_distinct(code_tokens(F.coalesce("title", F.lit("")))).alias("__tokens"), is_ai(F.col("source")).alias("__ai"), source_confidence(F.col("source")).alias("__base"),
    )
    out = T.StructType([*df.schema.fields, T.StructField("corroborating_sources", T.ArrayType(T.StringType())), T.StructField("members", T.LongType())])

    fields, names = list(df.columns), [f.name for f in out]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        runs = defaultdict(list)
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            runs[r["file_path"], r["category"], r["__island"]].append(r | {"__tokens": frozenset(r["__tokens"])})
        return pd.DataFrame([row for group in runs.values() for row in swept(group)], columns=names)

    def swept(group: list[dict]) -> list[dict]:
        group.sort(key=lambda r: (r["start_line"], -r["__rank"], r["ord"]))
        leaders, clusters = Leaders(Counter(t for r in group for t in r["__tokens"])), []
        for r in group:
            home = leaders.home(r)
            if home is None:
                leaders.add(r)
                clusters.append([r])
            else:
                clusters[home].append(r)
        merged = []
        for c in clusters:
            lead = max(c, key=lambda r: (r["__rank"], len(r["description"] or ""), not r["__ai"]))
            row = {k: lead[k] for k in fields} | {"corroborating_sources": [], "members": len(c)}
            if len(c) > 1:
                others = sorted({r["source"] for r in c if r is not lead})
                related = sorted({p for r in c for p in (r["related_files"] if r["related_files"] is not None else ())})[:8]
                row |= {"corroborating_sources": others, "start_line": min(r["start_line"] for r in c), "end_line": max(r["end_line"] for r in c), "related_files": related}
                row["confidence"] = round(min(0.99, 1 - (1 - (lead["confidence"] or lead["__base"])) * 0.65 ** len(others)), 3)
            merged.append(row)
        return merged

    run = ["file_path", "category", "__island"]
    held = written(islands(ready).withColumn("__many", F.count("*").over(Window.partitionBy(*run)) > 1), "findings")
    number = lambda f: F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)  # noqa: E731  as in pandas, NaN is no value
    alone = held.where("not __many").select(*map(number, df.schema.fields), F.array().cast("array<string>").alias("corroborating_sources"), F.lit(1).cast("long").alias("members"))
    bundles = max(1, -(-held.count() // bundle))
    many = held.where("__many").drop("__many").withColumn("__bundle", F.pmod(F.xxhash64(*run), F.lit(bundles)))
    return alone.unionByName(many.groupBy("__bundle").applyInPandas(merge, out))


def relevance(in_change: Column, has_changed_lines: Column, touches: Column, known_file: Column, has_dependents: Column) -> Column:
    """0.4 to 1.0 by how closely a finding lies to the change."""
    base = F.when(in_change & has_changed_lines & touches, 1.0).when(in_change & has_changed_lines, 0.7).when(in_change, 0.8).when(known_file, 0.5).otherwise(0.4)
    return F.round(F.when(has_dependents, F.least(F.lit(1.0), base + 0.1)).otherwise(base), 3)


def touches_changed_lines(changed: Column, start: Column, end: Column) -> Column:
    """Whether any changed line lies in the range; true where nothing is known to have changed."""
    return (F.size(changed) == 0) | F.exists(changed, lambda x: x.between(start, end))


def reproducibility(source: Column, category: Column, corroborating: Column) -> Column:
    """0.5 to 1.0 by how surely the issue shows again."""
    base = F.when(is_ai(source), 0.7).when(source.isin("tsc", "mypy", "pytest"), 1.0).otherwise(0.9) + 0.05 * F.least(corroborating, F.lit(3))
    base = F.when(category.isin("secret", "dependency"), F.greatest(base, F.lit(0.95))).when(category == "architecture", F.least(base, F.lit(0.75))).otherwise(base)
    return F.round(F.least(F.lit(1.0), base), 3)


def scored(df: DataFrame, relevance_col: Column, corroborating: Column) -> DataFrame:
    """score 0 to 100 with its factors; a missing or zero confidence is the source's prior."""
    given = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) != 0, F.col("confidence")).otherwise(source_confidence(F.col("source")))
    df = df.withColumns({"severity_weight": severity_weight(F.col("severity")), "scanner_confidence": F.round(given, 3), "contextual_relevance": relevance_col, "reproducibility_factor": reproducibility(F.col("source"), F.col("category"), corroborating)})
    raw = F.col("severity_weight") * given * F.col("contextual_relevance") * F.col("reproducibility_factor")
    return df.withColumns({"score": F.round(F.round(F.least(F.lit(100.0), raw * 100), 6), 1), "confidence": F.round(F.least(F.lit(1.0), given), 3)})


def ranked(df: DataFrame, *ties: str) -> DataFrame:
    """With rank from 1: severity, score and confidence falling, then the given columns."""
    order = [F.desc(severity_rank(F.col("severity"))), F.desc("score"), F.desc("confidence"), *(F.asc(c) for c in ties)]
    return dealt(df, "analysis_id").withColumn("rank", F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order)))


def dealt(df: DataFrame, *by: str, rows: int = 200_000) -> DataFrame:
    """The rows dealt by some columns to about a partition for every ``rows`` of them, so that what a task sorts does not grow with the table."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *by)


def over_threshold(df: DataFrame, threshold: str) -> DataFrame:
    return df.where(at_least(F.col("severity"), threshold))


def persistable(df: DataFrame, snippet: int = 4000) -> DataFrame:
    """The best-ranked row of each analysis and fingerprint, snippets cut to their column's length."""
    first = F.row_number().over(Window.partitionBy("analysis_id", "fingerprint").orderBy("rank"))
    out = df.withColumn("__n", first).where("__n = 1").drop("__n")
    return out.withColumn("code_snippet", F.substring("code_snippet", 1, snippet)) if "code_snippet" in df.columns else out


def firewall_severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").otherwise("medium")
