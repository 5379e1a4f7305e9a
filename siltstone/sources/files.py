"""Source trees, tool reports and dependency manifests as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siltstone.functions.dims import language_of, map_severity
from siltstone.functions.text import clamp_line, is_excluded, is_test_path, relative_path

# Folders that hold no source, and suffixes of files that are not read.
IGNORED = (
    ".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build",
    ".next", ".turbo", "coverage", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "vendor", "target", ".idea", ".vscode",
)
BINARY = (
    "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar",
    "woff", "woff2", "ttf", "eot", "mp4", "mp3", "so", "dll", "exe",
    "pyc", "class", "jar", "wasm", "lock",
)


def source_files(spark: SparkSession, root: str, excluded: list[str] = (), languages: list[str] | None = None, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """(path, content, language, size_bytes, is_test): readable UTF-8 text files below ``root``.

    Paths, and sizes if ``max_bytes`` is given, are filtered before content is decoded. ``max_files`` keeps the first
    by path, if given.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + "/" + root.split(":", 1)[-1].strip("/") + "/", "")
    out = (files if max_bytes is None else files.where(F.col("length") <= max_bytes)).select(path.alias("path"), "content", F.col("length").alias("size_bytes"))
    out = out.where(~F.col("path").rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + r")/"))
    out = out.where(~F.lower("path").rlike(r"\.(" + "|".join(BINARY) + ")$")).where(~is_excluded(F.col("path"), list(excluded)))
    out = out.withColumn("language", language_of(F.col("path")))
    if languages:
        out = out.where(F.col("language").isin(languages))
    out = out.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.decode("content", "UTF-8").alias("content"), "language", "size_bytes", is_test_path(F.col("path")).alias("is_test"))
    return out.orderBy("path").limit(max_files) if max_files else out


def decode_content(df: DataFrame, col: str = "content") -> DataFrame:
    """Base64 file contents, line breaks allowed, as text."""
    return df.withColumn(col, F.decode(F.unbase64(F.regexp_replace(col, r"\s", "")), "UTF-8"))


# Own values: the shape of each tool's report as far as it is read.
REPORTS = {
    "ruff": "array<struct<code:string,message:string,filename:string,location:struct<row:int>,end_location:struct<row:int>>>",
    "bandit": "struct<results:array<struct<test_id:string,issue_text:string,filename:string,line_number:int,issue_severity:string,issue_confidence:string>>>",
    "eslint": "array<struct<filePath:string,messages:array<struct<ruleId:string,message:string,severity:int,line:int,endLine:int>>>>",
    "npm_audit": "struct<vulnerabilities:map<string,struct<severity:string,range:string>>>",
    "semgrep": "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string>>>>",
    "gitleaks": "array<struct<RuleID:string,Description:string,File:string,StartLine:int,EndLine:int>>",
    "osv": "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string,summary:string,severity:array<struct<score:string>>,database_specific:struct<severity:string>>>>>>>>",
    "trivy": "struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Title:string,Severity:string>>,Misconfigurations:array<struct<ID:string,Title:string,Severity:string>>>>>",
}


def _finding(source: str, rule: Column, path: Column, start: Column, end: Column, severity: Column, title: Column) -> list[Column]:
    return [F.lit(source).alias("source"), rule.alias("rule_id"), path.alias("file_path"), clamp_line(start.cast("string")).alias("start_line"), F.greatest(clamp_line(start.cast("string")), clamp_line(end.cast("string"))).alias("end_line"), severity.alias("severity"), title.alias("title")]


def advisory_severity(x: Column) -> Column:
    """High where a CVSS vector is reachable over the network, else the word of the advisory's database, else medium."""
    remote = F.exists(F.coalesce(x["severity"], F.array().cast("array<struct<score:string>>")), lambda e: F.coalesce(e["score"], F.lit("")).rlike("^CVSS:.*/AV:[^/]*N"))
    return F.when(remote, "high").otherwise(map_severity(x["database_specific"]["severity"]))


def report_findings(reports: DataFrame, tool: str, root: str = "", report: str = "report") -> DataFrame:
    """(source, rule_id, file_path, start_line, end_line, severity, title) from a column of JSON reports; broken ones give none."""
    df = reports.select(F.from_json(report, REPORTS[tool]).alias("r"))
    from siltstone.operators.review import linter_severity

    c, path = F.col, lambda p: relative_path(p, root)
    if tool == "ruff":
        df = df.select(F.explode("r").alias("x"))
        return df.select(*_finding(tool, c("x.code"), path(c("x.filename")), c("x.location.row"), c("x.end_location.row"), linter_severity(c("x.code")), c("x.message")))
    if tool == "bandit":
        df = df.select(F.explode("r.results").alias("x"))
        return df.select(*_finding(tool, c("x.test_id"), path(c("x.filename")), c("x.line_number"), c("x.line_number"), map_severity(c("x.issue_severity")), c("x.issue_text")))
    if tool == "eslint":
        df = df.select(F.explode("r").alias("f")).select("f.filePath", F.explode("f.messages").alias("x"))
        return df.select(*_finding(tool, F.coalesce(c("x.ruleId"), F.lit("parse-error")), path(c("filePath")), c("x.line"), c("x.endLine"), F.when(c("x.severity") == 2, "medium").otherwise("low"), c("x.message")))
    if tool == "npm_audit":
        df = df.select(F.explode("r.vulnerabilities").alias("name", "x"))
        return df.select(*_finding(tool, F.concat(F.lit("npm:"), "name"), F.lit("package.json"), F.lit(1), F.lit(1), map_severity(c("x.severity")), F.concat(F.lit("Vulnerable dependency "), "name")))
    if tool == "semgrep":
        df = df.select(F.explode("r.results").alias("x"))
        return df.select(*_finding(tool, c("x.check_id"), path(c("x.path")), c("x.start.line"), c("x.end.line"), map_severity(c("x.extra.severity")), c("x.extra.message")))
    if tool == "gitleaks":
        df = df.select(F.explode("r").alias("x"))
        return df.select(*_finding(tool, c("x.RuleID"), path(c("x.File")), c("x.StartLine"), c("x.EndLine"), F.lit("critical"), c("x.Description")))
    if tool == "osv":
        df = df.select(F.explode("r.results").alias("s")).select("s.source.path", F.explode("s.packages").alias("p")).select("path", "p.package.name", F.explode("p.vulnerabilities").alias("x"))
        return df.select(*_finding(tool, c("x.id"), path(c("path")), F.lit(1), F.lit(1), advisory_severity(c("x")), F.concat("name", F.lit(": "), F.coalesce("x.summary", F.lit("known vulnerability")))))
    if tool == "trivy":
        df = df.select(F.explode("r.Results").alias("t"))
        vulnerable = df.select("t.Target", F.explode("t.Vulnerabilities").alias("x")).select("Target", c("x.VulnerabilityID").alias("id"), "x.Severity", "x.Title")
        wrong = df.select("t.Target", F.explode("t.Misconfigurations").alias("x")).select("Target", c("x.ID").alias("id"), "x.Severity", "x.Title")
        return vulnerable.unionByName(wrong).select(*_finding(tool, c("id"), path(c("Target")), F.lit(1), F.lit(1), map_severity(c("Severity")), c("Title")))
    raise ValueError(f"no such report: {tool}")


def text_report_findings(lines: DataFrame, tool: str, line: str = "value") -> DataFrame:
    """Findings from the line reports of mypy (notes left out) and tsc."""
    if tool == "mypy":
        pattern = r"^(.+?):(\d+)(?::\d+)?: (error|warning|note): (.*?)(?:\s+\[([^\]]+)\])?$"
        rule, level = F.regexp_extract(line, pattern, 5), F.regexp_extract(line, pattern, 3)
        return lines.where(F.col(line).rlike(pattern)).where(level != "note").select(*_finding(tool, rule, F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 2), map_severity(level), F.regexp_extract(line, pattern, 4)))
    pattern = r"^(.+?)\((\d+),\d+\): error (TS\d+): (.*)$"
    return lines.where(F.col(line).rlike(pattern)).select(*_finding(tool, F.regexp_extract(line, pattern, 3), F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 2), F.lit("high"), F.regexp_extract(line, pattern, 4)))


def dependencies(files: DataFrame) -> DataFrame:
    """(name, version): from package.json, requirements files and pyproject.toml; the first source in this order wins.

    files: path, content.
    """
    name = F.substring_index("path", "/", -1)
    package = files.where(name == "package.json").select(*[F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>").alias(s) for s in ("dependencies", "devDependencies", "peerDependencies")])
    parts = [package.select(F.explode(s).alias("name", "version"), F.lit(-i).alias("rank")) for i, s in enumerate(("dependencies", "devDependencies", "peerDependencies"))]  # a later section overwrites
    line = files.where(name.rlike(r"^requirements.*\.txt$")).select(F.explode(F.split("content", "\n")).alias("l"))
    pattern = r"^\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(.*?)\s*(?:#.*)?$"
    parts.append(line.where(F.col("l").rlike(r"^\s*[A-Za-z0-9]")).select(F.lower(F.regexp_extract("l", pattern, 1)).alias("name"), F.regexp_extract("l", pattern, 2).alias("version"), F.lit(1).alias("rank")))
    toml = files.where(name == "pyproject.toml").select(F.explode(F.regexp_extract_all("content", F.lit(r'"([A-Za-z0-9_.\-]+(?:\[[^\]]*\])?\s*[<>=!~][^"]*)"'), 1)).alias("l"))
    parts.append(toml.select(F.lower(F.regexp_extract("l", pattern, 1)).alias("name"), F.regexp_extract("l", pattern, 2).alias("version"), F.lit(2).alias("rank")))
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("rank", "version"))).where("__n = 1").select("name", "version")


# Frameworks by their dependencies and marker files.
FRAMEWORKS = (
    ("FastAPI", ("fastapi",), ()),
    ("Django", ("django",), ("manage.py",)),
    ("Flask", ("flask",), ()),
    ("SQLAlchemy", ("sqlalchemy", "sqlmodel"), ()),
    ("Celery", ("celery",), ()),
    ("Pydantic", ("pydantic",), ()),
    ("Next.js", ("next",), ("next.config.js", "next.config.mjs", "next.config.ts")),
    ("React", ("react",), ()),
    ("Express", ("express",), ()),
    ("NestJS", ("@nestjs/core",), ()),
    ("Prisma", ("prisma", "@prisma/client"), ("prisma/schema.prisma",)),
    ("Vue", ("vue",), ()),
    ("Svelte", ("svelte",), ()),
    ("Jest", ("jest",), ()),
    ("Vitest", ("vitest",), ()),
    ("pytest", ("pytest",), ("pytest.ini", "conftest.py")),
    ("Tailwind CSS", ("tailwindcss",), ("tailwind.config.js", "tailwind.config.ts")),
    ("Docker", (), ("Dockerfile", "docker-compose.yml")),
)


def frameworks(names: Column, paths: Column) -> Column:
    """ARRAY<STRING>: labels whose dependency or marker file is among the given arrays."""
    made = []
    for label, packages, markers in FRAMEWORKS:
        hit = F.lit(False)
        if packages:
            hit = hit | F.arrays_overlap(names, F.array(*map(F.lit, packages)))
        if markers:
            hit = hit | F.arrays_overlap(paths, F.array(*map(F.lit, markers)))
        made.append(F.when(F.coalesce(hit, F.lit(False)), label))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def language_lines(files: DataFrame, language: str = "language", content: str = "content") -> DataFrame:
    """(language, lines), most lines first, unknown languages left out."""
    return files.where(F.col(language) != "unknown").groupBy(language).agg(F.sum(F.size(F.split(content, "\n"))).cast("long").alias("lines")).orderBy(F.desc("lines"), language)
