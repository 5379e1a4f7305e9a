"""URL filtering against dated lists by an as-of join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.checkpoints import written

URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a url; both '' if it has none."""
    u = F.coalesce(url, F.lit(""))
    return F.lower(F.rtrim(F.regexp_extract(u, URL, 1), F.lit("."))), F.regexp_extract(u, URL, 2)


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to, action) from dated entries (pattern, at, action).

    Actions are 'block', 'allow' and 'remove'. An entry holds from its date until the next entry of its pattern, or
    for ever; 'remove' ends what held and opens nothing. Of entries with one date the last in the order allow,
    block, remove counts. Entries with a null field or another action are passed over. Patterns are hosts, which
    hold for their subdomains too, or a host and a path prefix that ends at a path segment.
    """
    clean = entries.select(F.lower(F.trim("pattern")).alias("p"), F.trim("pattern").alias("raw"), "at", "action").where("p <> '' and at is not null and action in ('block', 'allow', 'remove')")
    slash = F.instr("p", "/")
    clean = clean.select(F.when(slash == 0, F.col("p")).otherwise(F.concat(F.substring("p", F.lit(1), slash - 1), F.rtrim(F.regexp_replace(F.expr("substring(raw, instr(raw, '/'))"), "/+", "/"), F.lit("/")))).alias("pattern"), "at", "action")
    daily = clean.groupBy("pattern", "at").agg(F.max("action").alias("action"))
    nxt = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return daily.withColumn("valid_to", nxt).where("action <> 'remove'").select("pattern", F.col("at").alias("valid_from"), "valid_to", "action")


def listed_hosts(spans: DataFrame) -> DataFrame:
    """(listed, labels, lengths ARRAY<INT>): the hosts of the patterns, their number of labels, the lengths of the paths listed with each (0: none)."""
    slash = F.instr("pattern", "/")
    parts = spans.select(F.when(slash > 0, F.substring("pattern", F.lit(1), slash - 1)).otherwise(F.col("pattern")).alias("listed"), F.length("pattern").alias("n"))
    parts = parts.select("listed", F.size(F.split("listed", r"\.")).alias("labels"), (F.col("n") - F.length("listed")).alias("length"))
    return parts.groupBy("listed", "labels").agg(F.collect_set("length").alias("lengths"))


def suffixes(host: Column, labels: Column) -> Column:
    """The last labels of a host, for each number of labels that the list has; none of a host without labels."""
    own = F.size(F.split(host, r"\."))
    return F.when(host != "", F.transform(F.filter(labels, lambda k: k <= own), lambda k: F.call_function("substring_index", host, F.lit("."), -k)))


def prefixes(path: Column, lengths: Column) -> Column:
    """The path's beginnings of the listed lengths that end where a segment ends. Empty segments do not count."""
    size = F.length(path)
    fits = F.filter(lengths, lambda n: (n == 0) | (n == size) | ((n < size) & (F.substring(path, n + 1, F.lit(1)) == "/")))
    return F.transform(fits, lambda n: F.substring(path, F.lit(1), n))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", id_col: str = "page_id") -> DataFrame:
    """``captures`` with verdict STRING ('block', 'allow' or 'none') and matched STRING (the pattern, null for none).

    Each capture is judged by the entries in force at its fetch time: valid_from <= time < valid_to. The longest
    pattern decides; of equally long ones, the last in the order of strings. Dated entries become validity intervals,
    one row each, written once; an as-of join on pattern and time finds the one in force. A pattern's intervals do not
    overlap, so a capture meets one at most.

    A capture's candidates are bounded by the list, not by the url: its host's last labels in the numbers that listed
    hosts have are joined to the listed hosts, and of its path only the beginnings are built whose lengths the list
    has for that host. A url of many labels or segments thus costs time in proportion to its length.

    Candidates are made where the captures are read. Patterns that all captures share, such as a large host, sit on
    the capture side of the joins, where adaptive execution splits them; the best pattern is a partial aggregate.
    Spark broadcasts hosts and patterns only where their size is under its threshold.

    Null or unreadable urls, null times and an empty list: 'none'. An empty table gives no rows. Repeated rows stay.
    Columns verdict and matched are replaced; other columns may have any name that does not begin with two underscores.
    """
    base = captures.drop("verdict", "matched")
    asked = base.select(F.col(url_col).alias("__u"), F.col(time_col).alias("__t")).where("__u is not null and __t is not null")
    host, path = host_and_path(F.col("__u"))
    path = F.rtrim(F.regexp_replace(path, "/+", "/"), F.lit("/"))
    spans = written(validity(entries), "url-spans")
    hosts = listed_hosts(spans)
    labels = hosts.agg(F.array_sort(F.collect_set("labels"))).scalar()
    asked = asked.select("__u", "__t", host.alias("__h"), path.alias("__path"), labels.alias("__k")).select("__u", "__t", "__path", F.explode(suffixes(F.col("__h"), F.col("__k"))).alias("__h"))
    # new columns: both sides are exchanged, so hot hosts and patterns can be split
    hosts, spans = hosts.select(F.concat("listed", F.lit("")).alias("listed"), "lengths"), spans.select(F.concat("pattern", F.lit("")).alias("pattern"), "valid_from", "valid_to", "action")
    asked = asked.join(hosts, F.col("__h") == F.col("listed")).select("__u", "__t", "__h", F.explode(prefixes(F.col("__path"), F.col("lengths"))).alias("__p"))
    asked = asked.select("__u", "__t", F.concat("__h", "__p").alias("__p"))
    in_force = (F.col("valid_from") <= F.col("__t")) & (F.col("valid_to").isNull() | (F.col("__t") < F.col("valid_to")))
    hit = asked.join(spans, (F.col("__p") == F.col("pattern")) & in_force)
    best = hit.groupBy("__u", "__t").agg(F.max(F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("p"), F.col("action").alias("a"))).alias("__best"))
    out = base.join(best, (base[url_col] == best["__u"]) & (base[time_col] == best["__t"]), "left")
    return out.withColumns({"verdict": F.coalesce(F.col("__best.a"), F.lit("none")), "matched": F.col("__best.p")}).drop("__u", "__t", "__best")
