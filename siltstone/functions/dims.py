"""Small dimensions whose ordinals carry meaning, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Severities from worst to mildest with their weights.
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.55, "low": 0.3, "informational": 0.15}
SEVERITIES = tuple(SEVERITY_WEIGHT)
SEVERITY_RANK = {s: len(SEVERITIES) - i for i, s in enumerate(SEVERITIES)}

# Prior confidence of each producer of findings; others have DEFAULT_CONFIDENCE.
SOURCE_CONFIDENCE = {
    "gitleaks": 0.95,
    "osv": 0.95,
    "npm_audit": 0.9,
    "trivy": 0.9,
    "tsc": 0.95,
    "mypy": 0.85,
    "ruff": 0.85,
    "eslint": 0.8,
    "bandit": 0.75,
    "semgrep": 0.8,
    "ast_rules": 0.8,
    "graph": 0.7,
    "radon": 0.7,
    "pytest": 0.95,
    "firewall": 0.85,
    "custom_rule": 0.75,
}
DEFAULT_CONFIDENCE = 0.6

# The order of pipeline stages.
STAGES = ("queued", "cloning", "diffing", "detecting_languages", "parsing", "building_graph", "retrieving_context", "running_scanners", "ai_review", "merging_findings", "generating_patches", "validating_patches", "persisting", "done")

# USD for a million prompt and completion tokens, in order of precedence.
PRICES = (
    ("gemini-2.5-pro", 1.25, 10.0),
    ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-2.5-flash-lite", 0.10, 0.40),
    ("gemini-2.0-flash", 0.10, 0.40),
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("llama-3.1-8b-instant", 0.05, 0.08),
    ("local", 0.0, 0.0),
    ("heuristic", 0.0, 0.0),
)
DEFAULT_PRICE = (1.25, 10.0)

# Words that tools use for severities.
SEVERITY_WORDS = {
    "critical": "critical",
    "blocker": "critical",
    "error": "high",
    "high": "high",
    "warning": "medium",
    "medium": "medium",
    "moderate": "medium",
    "low": "low",
    "minor": "low",
    "note": "informational",
    "info": "informational",
    "informational": "informational",
    "style": "informational",
}

# File suffixes and languages.
SUFFIX_LANGUAGE = {
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "tsx": "tsx",
    "json": "json",
    "yml": "yaml",
    "yaml": "yaml",
    "md": "markdown",
}

# Names under which tools report the same rule.
RULE_ALIASES = {
    "sql-injection": "sqli",
    "sqli": "sqli",
    "b608": "sqli",
    "s608": "sqli",
    "hardcoded-password-string": "hardcoded-secret",
    "b105": "hardcoded-secret",
    "b106": "hardcoded-secret",
    "s105": "hardcoded-secret",
    "s106": "hardcoded-secret",
    "hardcoded-credential-comparison": "hardcoded-secret",
    "b301": "unsafe-deserialization",
    "s301": "unsafe-deserialization",
    "b307": "dynamic-code-execution",
    "s307": "dynamic-code-execution",
    "dynamic-code-execution": "dynamic-code-execution",
    "no-eval": "dynamic-code-execution",
    "path-traversal": "path-traversal",
    "b108": "path-traversal",
    "ssrf": "ssrf",
    "xss-inner-html": "xss",
    "react-no-danger": "xss",
}


def lookup(key: Column, table: dict, default=None) -> Column:
    """``table[key]`` as a literal map, evaluated where the row is; ``default`` if absent."""
    found = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK)


def severity_weight(severity: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHT)


def at_least(severity: Column, threshold: str) -> Column:
    """Ordinal comparison; never alphabetical."""
    return severity_rank(severity) >= F.lit(SEVERITY_RANK[threshold])


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, SEVERITY_RANK[s], SEVERITY_WEIGHT[s]) for s in SEVERITIES], "severity string, rank int, weight double")


def source_confidence(source: Column) -> Column:
    return lookup(source, SOURCE_CONFIDENCE, DEFAULT_CONFIDENCE)


def is_ai(source: Column) -> Column:
    return source.startswith("ai_")


def stage_progress(stage: Column) -> Column:
    """0 to 100 by the stage's place."""
    return lookup(stage, {s: round(100 * i / (len(STAGES) - 1)) for i, s in enumerate(STAGES)})


def map_severity(word: Column, default: str = "medium") -> Column:
    return lookup(F.lower(F.trim(F.coalesce(word, F.lit("")))), SEVERITY_WORDS, default)


# Prefixes of rule ids and categories; the first group that fits decides.
CATEGORY_PREFIXES = (
    ("security", ("S", "B", "sec", "security", "CWE")),
    ("performance", ("PERF", "C4", "SIM1", "n-plus")),
    ("reliability", ("ASYNC", "ARG", "TRY", "BLE", "RET")),
    ("testing", ("PT", "test", "PLR09")),
    ("code_quality", ("E", "W", "F", "N", "D", "I", "UP", "C90")),
)


def map_category(rule: Column, default: str = "code_quality") -> Column:
    text, out = F.trim(F.coalesce(rule, F.lit(""))), None
    for category, prefixes in CATEGORY_PREFIXES:
        hit = text.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(default)


def language_of(path: Column) -> Column:
    """By the suffix after the last dot, lower-cased; 'unknown' without a known one."""
    suffix = F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1))).otherwise("")
    return lookup(suffix, SUFFIX_LANGUAGE, "unknown")


def language_family(language: Column) -> Column:
    return F.when(language == "python", "python").when(language.isin("javascript", "typescript", "tsx"), "javascript").otherwise("other")


def is_analyzable(language: Column) -> Column:
    return language.isin("python", "javascript", "typescript", "tsx")


def normalise_rule(rule: Column) -> Column:
    """The last segment of a rule id, lower-case with hyphens, under its common name."""
    tail = F.lower(F.substring_index(F.substring_index(F.replace(rule, F.lit("_"), F.lit("-")), ".", -1), "/", -1))
    return lookup(tail, RULE_ALIASES, tail)


def call_cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """USD of a call, six places. The first priced name, in the table's order, that begins the model's name decides."""
    price = lambda i: _first_price(model, i)
    return F.round(F.round(prompt_tokens / 1_000_000 * price(1) + completion_tokens / 1_000_000 * price(2), 9), 6)


def _first_price(model: Column, field: int) -> Column:
    out = None
    for row in PRICES:
        hit = model.startswith(row[0])
        out = F.when(hit, row[field]) if out is None else out.when(hit, row[field])
    return out.otherwise(DEFAULT_PRICE[field - 1])
