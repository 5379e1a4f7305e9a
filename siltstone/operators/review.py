"""Smaller operators of a review: selection, labels, styles, text blocks, diffs, activity lines, webhooks."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from siltstone.operators.text import patch_rows

# Lines of the activity feed by action.
ACTIVITY = {
    "analysis.started": "Analysis started on {target}",
    "analysis.completed": "Analysis completed with {findings} findings",
    "analysis.failed": "Analysis failed: {error}",
    "patch.generated": "Fix proposed for {target}",
    "patch.approved": "Fix approved for {target}",
    "patch.rejected": "Fix rejected for {target}",
    "patch.validated": "Fix validated for {target}",
    "review.published": "AI review published on {target}",
    "fix_pr.created": "Fix pull request opened: {target}",
    "repository.synced": "Synced {count} repositories from GitHub",
    "auth.login": "Signed in via {method}",
    "webhook.received": "GitHub webhook received: {event}",
}
ACTIVITY_DEFAULTS = {"findings": "0", "error": "unknown error", "count": "0", "method": "GitHub", "event": "event"}

# Linter rules of high severity.
HIGH_RISK_RULES = ("S105", "S106", "S107", "S608", "S301", "S302", "S307", "S324", "S506", "S602", "S605")


def activity_line(action: Column, fields: Column, entity: Column) -> Column:
    """A readable line for an audit row; an action without a template is put in words."""
    words = F.replace(F.replace(action, F.lit("."), F.lit(" ")), F.lit("_"), F.lit(" "))
    text = None
    for name, template in ACTIVITY.items():
        text = F.when(action == name, template) if text is None else text.when(action == name, template)
    text = text.otherwise(F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substring(words, 2, 1000))))
    target = F.coalesce(F.element_at(fields, "target"), F.nullif(entity, F.lit("")), F.lit("resource"))
    text = F.replace(text, F.lit("{target}"), target)
    for name, default in ACTIVITY_DEFAULTS.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.element_at(fields, name), F.lit(default)))
    return text


def linter_severity(rule: Column) -> Column:
    return F.when(rule.isin(*HIGH_RISK_RULES), "high").when(rule.rlike("^[SFB]"), "medium").otherwise("low")


def pattern_category(category: Column, has_cwe: Column) -> Column:
    """Category of a pattern scanner's result from its metadata."""
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when((c == "security") | has_cwe, "security").when(c == "performance", "performance").when(c == "correctness", "bug").otherwise("code_quality")


def selected_scanners(scanners: DataFrame, enabled: Column, families: Column, always: tuple[str, ...] = ("builtin_secrets", "prompt_injection")) -> DataFrame:
    """scanners (name, families): those enabled or always on (all where ``enabled`` is null) whose family fits."""
    on = enabled.isNull() | F.array_contains(enabled, F.col("name")) | F.col("name").isin(*always)
    return scanners.where(on & ((F.col("families") == F.array(F.lit("any"))) | F.arrays_overlap("families", families)))


def ready_for_review(auto_scan: Column, status: Column, action: Column) -> Column:
    return auto_scan & ((status != "draft") | (action == "ready_for_review"))


def commit_subject(path: Column, category: Column, title: Column) -> Column:
    kind = F.when(category == "performance", "perf").when(category.isin("code_quality", "architecture"), "refactor").otherwise("fix")
    return F.concat(kind, F.lit("("), F.substring_index(path, "/", -1), F.lit("): "), F.substring(title, 1, 60))


def qualified_name(path: Column, parent: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."))).otherwise(""), name)


def style(content: Column, language: Column) -> Column:
    """STRUCT<tabs, width, quotes, semicolons, hints> from the first 400 lines."""
    lines = F.slice(F.split(content, "\n"), 1, 400)
    indented = F.filter(lines, lambda x: x.rlike("^[ \t]"))
    tabs = F.size(F.filter(indented, lambda x: x.startswith("\t"))) > F.size(indented) / 2
    widths = F.filter(F.transform(F.filter(indented, lambda x: x.startswith(" ")), lambda x: F.length(x) - F.length(F.ltrim(x))), lambda n: n.isin(2, 4))
    count = lambda mark: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit(mark))))
    ends = F.size(F.filter(lines, lambda x: F.rtrim(x).endswith(";")))
    hints = F.exists(lines, lambda x: F.ltrim(x).startswith("def ") & (x.contains("->") | x.contains(": ")))
    return F.struct(tabs.alias("tabs"), F.coalesce(F.get(widths, F.lit(0)), F.lit(4)).alias("width"), F.when(count('"') >= count("'"), "double").otherwise("single").alias("quotes"), (ends > F.size(lines) / 4).alias("semicolons"), ((language == "python") & hints).alias("hints"))


@F.pandas_udf(ArrayType(IntegerType()))
def locate_block(content: pd.Series, block: pd.Series) -> pd.Series:
    """[first line, last line] of the only place where the block stands, blank lines and indentation aside; else null."""

    def find(text: str | None, wanted: str | None):
        need = [x.strip() for x in (wanted or "").splitlines() if x.strip()]
        have = [(n, x.strip()) for n, x in enumerate((text or "").splitlines(), 1) if x.strip()]
        places = [i for i in range(len(have) - len(need) + 1) if [x for _, x in have[i : i + len(need)]] == need] if need else []
        return [have[places[0]][0], have[places[0] + len(need) - 1][0]] if len(places) == 1 else None

    return pd.Series([find(a, b) for a, b in zip(content, block)])


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
    """Unified diff text; empty if nothing changes."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for a, b, p in zip(before, after, path)])


def reindented(text: Column, width: Column) -> Column:
    """Every non-blank line behind so many spaces more."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(F.rpad(F.lit(""), width, " "), x))), "\n")


def signature_valid(secret: str):
    """A function of (body, header): whether the header is the body's HMAC-SHA-256; never true without a secret."""

    @F.pandas_udf(BooleanType())
    def check(body: pd.Series, header: pd.Series) -> pd.Series:
        own = [hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest() for b in body]
        return pd.Series([bool(secret) and isinstance(h, str) and h.startswith("sha256=") and hmac.compare_digest(h[7:], x) for h, x in zip(header, own)])

    return check


def webhooks(deliveries: DataFrame, secret: str) -> DataFrame:
    """(event, action, repository, number, status, draft) of signed pull-request deliveries (event, body, signature); works on streams."""
    shape = "struct<action:string,repository:struct<full_name:string>,pull_request:struct<number:int,state:string,draft:boolean,merged:boolean>>"
    from siltstone.operators.mutations import pull_request_status

    ok = deliveries.where(signature_valid(secret)(F.col("body"), F.col("signature"))).where("event = 'pull_request'").withColumn("b", F.from_json("body", shape))
    ok = ok.where(F.col("b.action").isin("opened", "reopened", "synchronize", "ready_for_review", "closed"))
    p = lambda f: F.coalesce(F.col(f"b.pull_request.{f}"), F.lit(False))
    return ok.select("event", "b.action", F.col("b.repository.full_name").alias("repository"), F.col("b.pull_request.number").alias("number"), pull_request_status(p("merged"), F.col("b.pull_request.state"), p("draft")).alias("status"), p("draft").alias("draft"))


def repaired_paths(named: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """named with real: the known path itself, else the smallest known path of which either is the other's ending, else null.

    Endings meet on the file name, which two such paths share.
    """
    k = known.select(F.col(path).alias("real")).distinct().withColumn("__name", F.substring_index("real", "/", -1))
    n = named.select(path).distinct().withColumn("__name", F.substring_index(path, "/", -1))
    fits = n.join(k, "__name").where((F.col("real") == F.col(path)) | F.col("real").endswith(F.col(path)) | F.col(path).endswith(F.col("real")))
    best = fits.groupBy(path).agg(F.min(F.struct((F.col("real") != F.col(path)).alias("other"), F.col("real").alias("r"))).alias("b")).select(F.col(path).alias("__path"), F.col("b.r").alias("real"))
    return named.join(best, F.col(path) == F.col("__path"), "left").drop("__path")


def query_text(title: DataFrame, changes: DataFrame, symbols: DataFrame, key: str, files: int | None = None, lines: int | None = None, most: int | None = None) -> DataFrame:
    """(key, query): title, then paths and added lines of the changes, then changed symbols.

    The first ``files`` changes, ``lines`` lines of each and ``most`` characters in all, where these are given.

    title: key, title; changes: key, ord, path, patch; symbols: key, name, signature, of changed files.
    """
    first = Window.partitionBy(key).orderBy("ord")
    added = F.transform(F.filter((F.split("patch", "\n") if lines is None else F.slice(F.split("patch", "\n"), 1, lines)), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x))))
    c = (changes if files is None else changes.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= files)).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.array("path"), added).alias("t")))), lambda s: s["t"])).alias("c"))
    s = symbols.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "signature"))).alias("s"))
    none = F.array().cast("array<string>")
    parts = F.filter(F.concat(F.array("title"), F.coalesce("c", none), F.coalesce("s", none)), lambda x: x != "")
    return title.join(c, key, "left").join(s, key, "left").select(key, (F.array_join(parts, "\n") if most is None else F.substring(F.array_join(parts, "\n"), 1, most)).alias("query"))


def _hinted(lines: list[str]) -> Iterator[tuple]:
    start = moved = 0
    for t in lines:
        if t.startswith("@@"):
            moved, named = 0, re.search(r"\+([0-9]+)", t)
            start = int(named[1]) if named and int(named[1]) < 1 << 31 else start
        elif t.startswith("+") and not t.startswith("+++"):
            moved += 1
            yield start + moved, t[1 : 1 + (1 << 20)]
        elif t.startswith(" "):
            moved += 1


def hinted_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, line, text) of added lines with the numbers a hasty reader gives them: counted from the hunk's start before
    each line, so one too high, and the start 0 before any hunk. Kept apart from ``changed_lines`` on purpose."""
    return patch_rows(patches, key, patch, "line int, text string", _hinted)


def complex_functions(symbols: DataFrame, least: int = 11, severe: int = 20) -> DataFrame:
    """(file_path, name, start_line, complexity, severity): functions over the limit of complexity."""
    return symbols.where(F.col("complexity") >= least).select("file_path", "name", "start_line", "complexity", F.when(F.col("complexity") >= severe, "medium").otherwise("low").alias("severity"))


class PagedSource:
    """A listing read page by page through a function page -> (rows, has_next), as a DataFrame of one partition a page.

    ``fetch`` runs on executors, must be safe to repeat, and is retried with growing pauses. Where the number of pages is
    not known, one task follows ``has_next`` page by page, to ``most`` rows if that is given.
    """

    def __init__(self, fetch, schema: str, retries: int = 3, pause: float = 0.5):
        self.fetch, self.schema, self.retries, self.pause = fetch, schema, retries, pause

    def load(self, spark, pages: int | None = None, most: int | None = None) -> DataFrame:
        fetch, retries, pause = self.fetch, self.retries, self.pause
        numbers = spark.range(1, 2 if pages is None else pages + 1, 1, max(1, pages or 1)).select(F.col("id").cast("int").alias("page"))
        shape = to_arrow_schema(spark.createDataFrame([], self.schema).schema)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import time

            for part in parts:
                for page in part.column(0).to_pylist():
                    left, more = most, True
                    while more and (left is None or left > 0):
                        for attempt in range(retries + 1):
                            try:
                                rows, more = fetch(page)
                                break
                            except OSError as error:
                                if attempt == retries:
                                    raise
                                time.sleep(getattr(error, "retry_after", None) or pause * 2**attempt)
                        rows = rows if left is None else rows[:left]
                        left = None if left is None else left - len(rows)
                        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], schema=shape)
                        page, more = page + 1, more and pages is None

        return numbers.mapInArrow(run, self.schema)


def patch_candidates(ranked: DataFrame, files: DataFrame, most: int | None = 12) -> DataFrame:
    """The first ``most`` findings, best first, that are worth a patch: of severity low or more, in a file at hand.

    ranked: file_path, severity, score, id; files: path.
    """
    worth = ranked.where(~F.lower("severity").isin("informational") & (F.col("file_path") != ""))
    out = worth.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").orderBy(F.desc("score"), "id")
    return out if most is None else out.limit(most)


def finding_summary(found: DataFrame, key: str, most: int = 25) -> DataFrame:
    """(key, summary): a line for each of a key's first ``most`` findings by score, and how many more there are.

    found: key, severity, title, file_path, start_line, score, id.
    """
    place = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "title", F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    rows = found.select(key, F.row_number().over(place).alias("n"), line.alias("t"))
    shown = rows.where(F.col("n") <= most).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("shown"))
    total = found.groupBy(key).agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > most, F.concat(F.lit("\n…and "), (F.col("total") - most).cast("string"), F.lit(" more"))).otherwise("")
    return shown.join(total, key).select(key, F.concat("shown", more).alias("summary"))


def restored(rows: DataFrame, **defaults) -> DataFrame:
    """Stored rows with the given values where a field is null; fields that the rows lack are added."""
    add = {c: F.lit(v) for c, v in defaults.items() if c not in rows.columns}
    fill = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in rows.columns}
    return rows.withColumns(add | fill)


def repository_order(repositories: DataFrame, analysed: str = "last_analyzed_at", name: str = "full_name") -> DataFrame:
    """Repositories that were analysed first, then by name."""
    return repositories.orderBy(F.col(analysed).isNull(), F.lower(name))


def context_or_diff(context: DataFrame, changes: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``context`` (key, file_path, content), and for keys without any the patches of their changes (key, path, patch), removed files and empty patches left out.

    ``most`` characters of a patch at most, if that is given.
    """
    diff = changes.join(context.select(key).distinct(), key, "left_anti").where("coalesce(patch, '') <> '' and coalesce(status, '') <> 'removed'")
    text = F.col("patch") if most is None else F.substring("patch", 1, most)
    return context.select(key, "file_path", "content").unionByName(diff.select(key, F.col("path").alias("file_path"), text.alias("content")))
