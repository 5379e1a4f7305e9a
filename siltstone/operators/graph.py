"""Property graphs as two DataFrames: nodes (id, type, file_path, label, ord, ...) and edges (id, source, target, type, ord)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.checkpoints import forget, written
from siltstone.functions.text import fnv1a, identifier_tokens, log_scaled, normal_path

# The order of node and edge types in feature vectors, and the width of the hashed names.
NODE_TYPES = ("file", "module", "class", "function", "route", "model", "test", "dependency", "constant")
EDGE_TYPES = ("imports", "calls", "extends", "implements", "tests", "reads", "writes", "contains", "depends_on")
NAME_WIDTH = 32


def assemble(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first node and edge of each id by ord; edges with both ends present; optional caps in that order."""
    first = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("__n = 1").drop("__n")
    nodes = first(nodes)
    if max_nodes is not None:
        nodes = nodes.orderBy("ord").limit(max_nodes)
    edges = between(first(edges), nodes)
    return nodes, edges if max_edges is None else edges.orderBy("ord").limit(max_edges)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    a, b = nodes.select(F.col("id").alias("__a")), nodes.select(F.col("id").alias("__b"))
    return edges.join(a, edges["source"] == a["__a"], "left_semi").join(b, edges["target"] == b["__b"], "left_semi")


def import_candidates(module: Column, importer: Column) -> Column:
    """Paths that an import may mean, the likeliest first."""
    folder = F.when(F.instr(importer, "/") > 0, F.regexp_replace(importer, "/[^/]*$", "")).otherwise("")
    inside = lambda tail: normal_path(F.concat(folder, F.lit("/"), tail))
    script = [F.concat(inside(module), F.lit(s)) for s in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", ".py")]
    dotted = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    python = [F.concat(dotted, F.lit(s)) for s in (".py", "/__init__.py")] + [F.concat(inside(dotted), F.lit(s)) for s in (".py", "/__init__.py")]
    some = F.when(dotted != "", F.array(*python)).otherwise(F.array().cast("array<string>"))
    return F.when(module.startswith("."), F.concat(F.array(*script), some)).otherwise(some)


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (ord, module, file_path) with resolved: the first candidate that is a known path, else null."""
    tried = imports.select("ord", F.posexplode(import_candidates(F.col("module"), F.col("file_path"))).alias("place", "path"))
    hit = tried.join(paths.select("path").distinct(), "path").groupBy("ord").agg(F.min_by("path", "place").alias("resolved"))
    return imports.join(hit, "ord", "left")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (ord, callee) with target: the first symbol, in order, named like the callee's last part."""
    first = symbols.groupBy(F.col("name").alias("__name")).agg(F.min_by("id", "ord").alias("target"))
    return calls.withColumn("__name", F.element_at(F.split("callee", r"\."), -1)).join(first, "__name", "left").drop("__name")


def base_class_edges(classes: DataFrame) -> DataFrame:
    """(source, target) from a class to a base of the same file that is declared before it, the latest if several.

    An as-of join without meeting: declarations and asks of a name lie in one order, cut into ranges of rows. Each range
    is one sorted pass, and the last declarations of a name are handed on from range to range, so a name of any number
    of declarations is split, and work grows with the rows.
    """
    names = classes.select("file_path", "name", "ord", F.lit(0).alias("asks"), "id")
    asks = classes.select("file_path", F.explode("bases").alias("name"), "ord", F.lit(1).alias("asks"), "id")
    rows = asks.unionByName(names).where("file_path is not null and name is not null and ord is not null")
    rows = written(rows.repartitionByRange("file_path", "name", "ord").withColumn("range", F.spark_partition_id()), "bases")
    # asks come before the declarations of the same place in the order, of which they are not to find any
    before = Window.partitionBy("file_path", "name", "range").orderBy("ord", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.struct("ord", "id")
    near = rows.withColumn("near", F.last(F.when(F.col("asks") == 0, base), ignorenulls=True).over(before)).where("asks = 1")
    ends = rows.where("asks = 0").groupBy("file_path", "name", "range").agg(F.max(base).alias("end"))
    spread = rows.select("file_path", "name", "range").distinct().join(ends, ["file_path", "name", "range"], "left")
    carried = spread.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("file_path", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).where("carried is not null")
    found = near.join(carried.select("file_path", "name", "range", "carried"), ["file_path", "name", "range"], "left").withColumn("base", F.coalesce("near", "carried")).where("base is not null")
    return found.groupBy(F.col("id").alias("source"), "name").agg(F.max("base").alias("last")).select("source", F.col("last.id").alias("target"))


def reach(edges: DataFrame, starts: DataFrame, depth: int, forward: bool = True, types: tuple[str, ...] | None = ("imports",)) -> DataFrame:
    """(start, id, depth): nodes reached from each start within ``depth`` steps, each at its least depth; starts left out.

    A frontier of new nodes per step, found by joins on node ids; what has been seen is taken out by an anti-join,
    so work grows with the edges reached and not with the paths. starts: a column start.
    """
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    e = written(e.select(F.col("source" if forward else "target").alias("at"), F.col("target" if forward else "source").alias("id")).distinct(), "reach")
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for step in range(1, depth + 1):
        new = frontier.select("start", F.col("id").alias("at")).join(e, "at").select("start", "id").distinct()
        frontier = written(new.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(step)), "reach")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def blast_radius(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """What depends on each start through imports and calls."""
    return reach(edges, starts, depth, forward=False, types=("imports", "calls"))


def dependencies(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    return reach(edges, starts, depth)


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """(a, b, path): a shortest path over all edges of at most ``depth`` + 1 steps, the smallest by node ids among equals."""
    e = written(edges.select("source", "target").distinct(), "paths")
    seen = pairs.select("a", F.col("a").alias("at"), F.array("a").alias("path")).distinct()
    frontier = seen
    for _ in range(depth + 1):
        step = frontier.join(e.select(F.col("source").alias("at"), "target"), "at").groupBy("a", "target").agg(F.min("path").alias("path"))
        step = step.select("a", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
        frontier = written(step.join(seen.select("a", "at"), ["a", "at"], "left_anti"), "paths")
        seen = seen.unionByName(frontier)
    found = seen.where(F.size("path") > 1).select("a", F.col("at").alias("b"), "path")
    return pairs.select("a", "b").join(found, ["a", "b"]).select("a", "b", "path")


def covering_tests(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, test): tests that import a node."""
    tests = nodes.where("is_test").select(F.col("id").alias("test"))
    return edges.where("type = 'imports'").join(tests, F.col("source") == F.col("test")).select(F.col("target").alias("id"), "test").distinct()


def untested_hubs(edges: DataFrame, nodes: DataFrame, changed: DataFrame, dependents: int = 3, severe: int = 8) -> DataFrame:
    """(id, dependents, severity): changed nodes that many depend on and no test imports."""
    hubs = blast_radius(edges, changed.select(F.col("id").alias("start"))).groupBy(F.col("start").alias("id")).agg(F.countDistinct("id").alias("dependents")).where(F.col("dependents") >= dependents)
    return hubs.join(covering_tests(edges, nodes).select("id"), "id", "left_anti").withColumn("severity", F.when(F.col("dependents") >= severe, "high").otherwise("medium"))


def short_cycles(edges: DataFrame, longest: int = 3, types: tuple[str, ...] = ("imports",)) -> DataFrame:
    """(cycle ARRAY): all simple cycles of 2 to ``longest`` nodes, each once, from its smallest node on."""
    e = edges.where(F.col("type").isin(*types)).where("source <> target").select("source", "target").distinct()
    paths = e.where("source < target").select(F.array("source", "target").alias("p"))
    out = []
    for n in range(2, longest + 1):
        back = paths.join(e.withColumnsRenamed({"source": "s", "target": "t"}), (F.element_at("p", -1) == F.col("s")) & (F.element_at("p", 1) == F.col("t"))).select(F.col("p").alias("cycle"))
        out.append(back)
        if n < longest:
            nxt = paths.join(e, F.element_at("p", -1) == F.col("source")).where((F.col("target") > F.element_at("p", 1)) & ~F.array_contains("p", F.col("target")))
            paths = nxt.select(F.concat("p", F.array("target")).alias("p"))
    return reduce(DataFrame.unionByName, out)


def cyclic_core(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id): nodes on import cycles of any length, and between two cycles: those left when nodes without an edge in or out are peeled off."""
    e = edges.where("type = 'imports' and source <> target").select("source", "target").distinct()
    before = None
    for _ in range(rounds):
        e = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        e = written(e, "core")
        n = e.count()
        if n == before:
            break
        before = n
    return e.select(F.col("source").alias("id")).distinct()


def strong_components(edges: DataFrame, types: tuple[str, ...] = ("imports",), log: list[tuple[str, int]] | None = None) -> DataFrame:
    """(id, component: its smallest id, size BIGINT): the nodes on cycles of any length, by strongly connected component.

    By colours: nodes without an edge in or out are peeled off; then every node takes the largest id that reaches it as its colour;
    the nodes of a colour that reach, within it, the node that has it as its id are a component and leave the graph; and again with the rest. Each
    round is written, so a lost executor costs a round at most, and only counts reach the driver. Joins are by node, edges
    are never gathered by component, and no table is broadcast: small ones would pass through the driver in every round. ``log`` gets the name of each step and the rows that it changed.

    Edges of a node with itself, repeated edges and null ends are left out; components of one node are not returned. The
    number of rounds grows with the longest path along which a colour travels, not with the number of cycles.
    """
    spark, log = edges.sparkSession, log if log is not None else []
    e = written(edges.where(F.col("type").isin(*types)).where("source <> target").select("source", "target").distinct(), "scc-edges")
    kinds = f"id {edges.schema['source'].dataType.simpleString()}, component {edges.schema['source'].dataType.simpleString()}"
    found = spark.createDataFrame([], kinds)

    def counted(step: str, df: DataFrame, changed: Column | None = None) -> int:
        log.append((step, (df.where(changed) if changed is not None else df).count()))
        return log[-1][1]

    def repeated(df: DataFrame, step: Callable[[DataFrame], DataFrame], times: int, name: str) -> DataFrame:
        """Some steps in one written table: fewer jobs, and plans stay short."""
        new = reduce(lambda x, _: step(x), range(times), df)
        new = written(new, name)
        forget(df)
        return new

    def peel(e: DataFrame) -> DataFrame:
        ends = lambda c, by: e.select(F.col(c).alias(by)).distinct()
        return e.join(ends("target", "source").hint("merge"), "source", "left_semi").join(ends("source", "target").hint("merge"), "target", "left_semi").select("source", "target")

    def peeled(e: DataFrame) -> DataFrame:
        left = counted("peel", e)
        while left:
            e = repeated(e, peel, 3, "scc-edges")
            was, left = left, counted("peel", e)
            if left == was:
                break
        return e

    def spread(colours: DataFrame) -> DataFrame:
        told = e.join(colours.where("fresh").select(F.col("id").alias("source"), "colour").hint("merge"), "source").groupBy(F.col("target").alias("id")).agg(F.max("colour").alias("told"))
        return colours.join(told.hint("merge"), "id", "left").select("id", F.greatest("colour", "told").alias("colour"), F.coalesce(F.col("told") > F.col("colour"), F.lit(False)).alias("fresh"))

    def back(reach: DataFrame) -> DataFrame:
        met = inside.join(reach.where("fresh").select(F.col("id").alias("target")).hint("merge"), "target").select(F.col("source").alias("id")).distinct().withColumn("met", F.lit(True))
        met = reach.join(met.hint("merge"), "id", "left").withColumn("met", F.coalesce("met", F.lit(False)))
        return met.select("id", "colour", (F.col("reached") | F.col("met")).alias("reached"), (~F.col("reached") & F.col("met")).alias("fresh"))

    e = peeled(e)
    while log[-1][1]:
        colours = written(e.select(F.col("source").alias("id")).distinct().withColumn("colour", F.col("id")).withColumn("fresh", F.lit(True)), "scc-colours")
        while counted("colour", colours, F.col("fresh")):
            colours = repeated(colours, spread, 3, "scc-colours")
        inside = e.join(colours.select(F.col("id").alias("source"), F.col("colour").alias("c1")).hint("merge"), "source").join(colours.select(F.col("id").alias("target"), F.col("colour").alias("c2")).hint("merge"), "target").where("c1 = c2").select("source", "target")
        inside = written(inside, "scc-inside")
        reach = written(colours.select("id", "colour", (F.col("id") == F.col("colour")).alias("reached"), (F.col("id") == F.col("colour")).alias("fresh")), "scc-reach")
        while counted("back", reach, F.col("fresh")):
            reach = repeated(reach, back, 3, "scc-reach")
        own = written(reach.where("reached").select("id", "colour"), "scc-found")
        least = own.groupBy("colour").agg(F.min("id").alias("component"))
        found = found.unionByName(own.join(least.hint("merge"), "colour").select("id", "component"))
        rest = e.join(own.select(F.col("id").alias("source")).hint("merge"), "source", "left_anti").join(own.select(F.col("id").alias("target")).hint("merge"), "target", "left_anti")
        before, e = e, written(rest.select("source", "target"), "scc-edges")
        forget(before), forget(colours), forget(inside), forget(reach)
        e = peeled(e)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes.hint("merge"), "component").select("id", "component", "size")


def impact(edges: DataFrame, origins: DataFrame, types: tuple[str, ...] = ("imports", "calls", "tests")) -> DataFrame:
    """(origin, nodes ARRAY sorted, edges ARRAY sorted): what a defect can reach in two steps against the edges."""
    e = edges.where(F.col("type").isin(*types)).select("id", "source", "target")
    one = origins.select("origin").join(e, F.col("origin") == F.col("target")).select("origin", "id", "source")
    two = one.select("origin", F.col("source").alias("mid")).distinct().join(e, F.col("mid") == F.col("target")).select("origin", "id", "source")
    steps = one.unionByName(two).groupBy("origin").agg(F.collect_set("source").alias("n"), F.array_sort(F.collect_list("id")).alias("edges"))
    out = origins.select("origin").join(steps, "origin", "left")
    return out.select("origin", F.array_sort(F.array_union(F.array("origin"), F.coalesce("n", F.array().cast("array<string>")))).alias("nodes"), F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))


def ring_distance(edges: DataFrame, nodes: DataFrame, focus, longest: int = 6) -> DataFrame:
    """(id, ring): steps from the focus over edges either way; unreached nodes lie one ring beyond the last."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    start = nodes.where(F.col("id") == F.lit(focus)).select(F.col("id").alias("start"))
    rings = reach(both.withColumn("type", F.lit("any")), start, longest, types=None).select("id", F.col("depth").alias("ring")).unionByName(start.select(F.col("start").alias("id"), F.lit(0).alias("ring")))
    last = rings.agg(F.max("ring")).scalar()
    return nodes.select("id").join(rings, "id", "left").select("id", F.coalesce(F.col("ring"), last + 1).alias("ring"))


def undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each pair of linked nodes both ways, once."""
    e = between(edges, nodes)
    return e.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 30, cut_every: int = 5) -> DataFrame:
    """(id, rank): PageRank over undirected links, the rank of unlinked nodes spread over all, divided by the largest.

    Each round joins ranks to links by node, sums by the other end in two phases, and adds the share of the
    unlinked, a scalar. Links stay partitioned by node through all rounds; lineage is cut every few rounds.
    """
    ids = nodes.select("id").distinct()
    links = written(undirected(edges, nodes), "links")
    degree = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("deg"))
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    state = written(ids.join(degree, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(1.0 / n).alias("rank")), "rank")
    for i in range(rounds):
        sent = state.where("deg > 0").select("id", (damping * F.col("rank") / F.col("deg")).alias("share"))
        got = links.join(sent, links["a"] == sent["id"]).groupBy(F.col("b").alias("id")).agg(F.sum("share").alias("got"))
        loose = state.where("deg = 0").agg(damping * F.coalesce(F.sum("rank"), F.lit(0.0)) / n).scalar()
        state = state.drop("rank").join(got, "id", "left").select("id", "deg", ((1 - damping) / n + F.coalesce("got", F.lit(0.0)) + loose).alias("rank"))
        if i % cut_every == cut_every - 1:
            state = written(state, "rank")
    return state.select("id", (F.col("rank") / state.agg(F.max("rank")).scalar()).alias("rank"))


def add_arrays(col: Column, width: int) -> list[Column]:
    return [F.sum(col[i]).alias(f"s{i}") for i in range(width)]


def propagate(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, width: int, hops: int = 2, rows: int = 50_000) -> DataFrame:
    """(id, v): symmetric-normalised neighbourhood sums with self-loops, ``hops`` times, then unit length.

    A hop is one join and one element-wise sum by node, in two steps, so that a node of very many links is summed by several
    tasks. Rows are dealt to a partition for about every ``rows`` of them: vectors are mostly zeros and their shuffle
    files small, so adaptive execution would put all of them into a few tasks. vectors: id, v.
    """
    from siltstone.operators.vectors import unit

    links = written(undirected(edges, nodes), "links")
    n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-(links.count() + nodes.count()) // rows))
    degree = nodes.select("id").join(links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("d"))
    ways = links.where("a <> b").unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))
    weights = ways.join(degree.withColumnsRenamed({"id": "a", "d": "da"}), "a").join(degree.withColumnsRenamed({"id": "b", "d": "db"}), "b").select("a", "b", (1 / F.sqrt(F.col("da") * F.col("db"))).alias("w"))
    out = vectors.select("id", "v")
    for _ in range(hops):
        sent = weights.repartition(n, "a").join(out.repartition(n, "id").hint("merge"), F.col("a") == F.col("id"))
        out = sent.select(F.col("b").alias("id"), F.pmod(F.xxhash64("a"), F.lit(16)).alias("part"), F.transform("v", lambda x: x * F.col("w")).alias("v"))
        for by in (["id", "part"], ["id"]):
            out = out.repartition(n, *by).groupBy(*by).agg(*add_arrays(F.col("v"), width)).select(*by, F.array(*[f"s{i}" for i in range(width)]).alias("v"))
    return out.select("id", unit(F.col("v")).alias("v"))


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, v of 65): role, structure, degrees by direction and type, hashed name parts; unit length.

    nodes: id, type, label, file_path, start_line, end_line, changed, is_test, finding_count.
    """
    from siltstone.operators.vectors import norm, unit

    def degrees(end: str, tag: str) -> DataFrame:
        return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(f"{tag}_all"), *[F.count_if(F.col("type") == t).alias(f"{tag}_{t}") for t in EDGE_TYPES])

    n = nodes.join(degrees("source", "out"), "id", "left").join(degrees("target", "in"), "id", "left").na.fill(0)
    tokens = F.transform(identifier_tokens(F.concat_ws(" ", "label", "file_path")), lambda t: F.pmod(fnv1a(t), F.lit(NAME_WIDTH)))
    n = n.withColumn("__t", tokens)
    names = F.transform(F.sequence(F.lit(0), F.lit(NAME_WIDTH - 1)), lambda i: F.size(F.filter("__t", lambda t: t == i)).cast("double"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = [flag(F.col("type") == t) for t in NODE_TYPES]
    parts += [log_scaled(F.col("out_all")), log_scaled(F.col("in_all")), log_scaled(F.col("end_line") - F.col("start_line")), flag(F.col("changed")), flag(F.col("is_test")), log_scaled(F.coalesce("finding_count", F.lit(0)))]
    parts += [log_scaled(F.col(f"{tag}_{t}")) for tag in ("out", "in") for t in EDGE_TYPES]
    n = n.withColumn("__names", names)
    lexical = F.when(norm(F.col("__names")) > 0, F.transform("__names", lambda x: x / norm(F.col("__names")))).otherwise(F.col("__names"))
    return n.select("id", F.concat(F.array(*parts), lexical).alias("v")).select("id", unit(F.col("v")).alias("v"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): nodes by type and the totals of nodes and edges."""
    by = nodes.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    return by.unionByName(nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), "n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"))


def with_finding_counts(nodes: DataFrame, findings: DataFrame, files_only: bool) -> DataFrame:
    """nodes with finding_count: all nodes of a file inherit its count, or only the file's own node ('file:' + path)."""
    counts = findings.groupBy("file_path").agg(F.count("*").alias("finding_count"))
    if files_only:
        counts = counts.select(F.concat(F.lit("file:"), "file_path").alias("id"), "finding_count")
        return nodes.join(counts, "id", "left").na.fill(0, ["finding_count"])
    return nodes.join(counts, "file_path", "left").na.fill(0, ["finding_count"])
