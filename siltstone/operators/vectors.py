"""Vectors: similarity, search, hashed embeddings, hybrid ranking, budgets."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from siltstone.checkpoints import written
from siltstone.functions.text import code_tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length one; zero stays zero."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, within -1 and 1; 0 for missing vectors or other lengths."""
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


#: Scores that a task holds at once, of a product of queries and rows.
PRODUCTS = 1 << 20


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1, 1))


def _unit_rows(df: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    """(name, u): rows with a vector of numbers, at length one or zero."""
    u = df.select(F.col(id_col).alias(name), unit(F.col(vector)).alias("u"))
    return u.where(F.col("u").isNotNull() & ~F.exists("u", lambda x: x.isNull() | F.isnan(x)))


def _placed(rows: DataFrame, centres: list[np.ndarray], width: float) -> DataFrame:
    """``rows`` with c (the nearest centre of the same length), ring (the angle to it over ``width``) and angle; c is -1
    for zero vectors and for lengths that no centre has."""
    by_size = {n: [i for i, x in enumerate(centres) if len(x) == n] for n in {len(x) for x in centres}}
    shape = T.StructType([*rows.schema.fields, T.StructField("c", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            c, ring, angle = np.full(len(part), -1, "i4"), np.zeros(len(part), "i4"), np.zeros(len(part))
            sizes = part["u"].map(len).to_numpy()
            for n, mine in by_size.items():
                at = np.flatnonzero(sizes == n)
                if len(at):
                    u = np.stack(part["u"].to_numpy()[at])
                    near = _angles(u, np.stack([centres[i] for i in mine]))
                    best, some = near.argmin(1), u.any(1)
                    c[at] = np.where(some, np.array(mine)[best], -1)
                    angle[at] = np.where(some, near[np.arange(len(at)), best], 0)
                    ring[at] = (angle[at] / width).astype("i4")
            yield part.assign(c=c, ring=ring, angle=angle)

    return rows.mapInPandas(place, shape)


def _visits(asked: DataFrame, centres: list[np.ndarray], directory: list, k: int, slack: float) -> DataFrame:
    """(query, u, c, ring): the cells a query has to look at.

    A member of a cell is at least max(0, a - hi, lo - a) away from a query at angle a from the cell's centre, where lo
    and hi are the least and greatest angle of its members. With a null ``least`` these are the first cells by that
    bound that hold more than k rows together; with a score in ``least``, all others that can hold a row of that score.
    """
    c, ring = np.array([d["c"] for d in directory]), np.array([d["ring"] for d in directory])
    lo, hi, n = (np.array([d[x] for d in directory]) for x in ("lo", "hi", "n"))
    sizes = np.array([len(centres[i]) if i >= 0 else -1 for i in c])
    shape = T.StructType([asked.schema["query"], asked.schema["u"], T.StructField("c", T.IntegerType()), T.StructField("ring", T.IntegerType())])

    def cells(u: np.ndarray, least: float | None) -> np.ndarray:
        bound = np.where(sizes == len(u), 1.0, np.where(sizes < 0, 1.0, -9.0))
        same = np.flatnonzero(sizes == len(u))
        if len(same) and u.any():
            own = np.unique(c[same])
            to = np.zeros(len(centres))
            to[own] = _angles(u[None], np.stack([centres[i] for i in own]))[0]
            bound[same] = np.cos(np.maximum(0, np.maximum(to[c[same]] - hi[same], lo[same] - to[c[same]])))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > -2]
        first = int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1
        rest = order[first:]
        return order[:first] if least is None else rest[bound[rest] + slack >= least]

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 16):  # a query's vector goes along to each of its cells
                some = part.iloc[a : a + 16]
                at = [cells(np.asarray(u), None if pd.isna(least) else least) for u, least in zip(some["u"], some["least"])]
                rows, to = some[["query", "u"]].loc[some.index.repeat([len(x) for x in at])], np.concatenate(at)
                for b in range(0, len(rows), 4096):
                    yield rows.iloc[b : b + 4096].assign(c=c[to[b : b + 4096]], ring=ring[to[b : b + 4096]])

    return asked.mapInPandas(visit, shape)


def _scored(queries: np.ndarray, asks: np.ndarray, ids: np.ndarray, to: np.ndarray, k: int, min_score: float, digits: int) -> list[tuple]:
    """(query, id, score): the k best of the rows ``to`` for each of ``asks``, in products of bounded size."""
    found, step = [], max(1, PRODUCTS // len(to))
    for a in range(0, len(asks), step):
        scores = np.round(np.clip(asks[a : a + step] @ to.T, -1, 1), digits)
        for n, s in zip(queries[a : a + step], scores):
            at = np.flatnonzero((s >= min_score) & (ids != n))
            at = at[np.argsort(-s[at], kind="stable")[:k]]
            found += [(n, ids[i], s[i]) for i in at]
    return found


def _met(rows: DataFrame, visits: DataFrame, k: int, min_score: float, digits: int, block: int, batch: int) -> DataFrame:
    """(query, id, score): the k best rows of a query in each part of the cells that it visits."""
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("query", visits.schema["query"].dataType), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    parts = rows.groupBy("c", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    batches = visits.groupBy("c", "ring").agg(F.ceil(F.count("*") / batch).cast("int").alias("batches"))
    split = parts.join(batches, ["c", "ring"])
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    left = rows.join(split, ["c", "ring"]).select("id", "u", "c", "ring", dealt("id", "parts").alias("part"), upto("batches").alias("j"))
    right = visits.join(split, ["c", "ring"]).select("query", "u", "c", "ring", dealt("query", "batches").alias("j"), upto("parts").alias("part"))

    def tile(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size, mine in asked.groupby(asked["u"].map(len)):
            fit = rows[rows["u"].map(len) == size].sort_values("id")
            if not len(fit):
                continue
            found += _scored(mine["query"].to_numpy(), np.stack(mine["u"].to_numpy()), fit["id"].to_numpy(), np.stack(fit["u"].to_numpy()), k, min_score, digits)
        return pd.DataFrame(found, columns=["query", "id", "score"])

    key = ["c", "ring", "part", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, out)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(vectors: DataFrame, queries: DataFrame, k: int, min_score: float, id_col: str = "id", vector: str = "v", exclude: DataFrame | None = None, digits: int = 6, block: int = 1 << 14, batch: int = 1 << 12, centres: int = 256, width: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The rows of ``neighbours`` and, beside them, (products, of): scalar products taken, and what all pairs would take.

    The index is ``centres`` rows, the first by hash; each row goes to the cell of its nearest centre and of its angle to
    it in steps of ``width``. The cells' counts and angles, at most centres * pi / width, and the centres are all that
    tasks are sent. A query looks at the nearest cells that hold more than k rows, then at every cell that can hold a
    row as good as its k-th so far; other cells are skipped by a bound on angles, so results are exact. A cell is met in
    parts of some ``block`` rows and ``batch`` queries, each one task's matrix product, so large cells and cells that
    many queries visit are split.
    """
    base = vectors if exclude is None else vectors.join(exclude, id_col, "left_anti")
    v, q = _unit_rows(base, id_col, vector, "id"), _unit_rows(queries, id_col, vector, "query")
    picked = [np.array(r["u"]) for r in v.where(F.exists("u", lambda x: x != 0)).select("u", F.xxhash64("id", "u").alias("h")).orderBy("h").limit(centres).collect()]
    rows = written(_placed(v, picked, width), "vectors")
    directory = rows.groupBy("c", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).orderBy("c", "ring").collect()
    slack = 10.0**-digits + 1e-9
    first = written(_visits(q.withColumn("least", F.lit(None).cast("double")), picked, directory, k, slack), "visits")
    near = written(_met(rows, first, k, min_score, digits, block, batch), "near")
    reached = _best(near, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    least = reached.select("query", F.when(F.col("n") >= k, F.col("s")).alias("s"))
    asked = q.join(least, "query", "left").select("query", "u", F.greatest(F.lit(float(min_score)), F.coalesce("s", F.lit(float(min_score)))).alias("least"))
    second = written(_visits(asked, picked, directory, k, slack), "visits")
    found = near.unionByName(_met(rows, second, k, min_score, digits, block, batch))
    sizes = rows.groupBy("c", "ring").agg(F.count("*").alias("n"))
    products = first.select("c", "ring").unionByName(second.select("c", "ring")).groupBy("c", "ring").agg(F.count("*").alias("m")).join(sizes, ["c", "ring"]).agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("products"))
    every = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).crossJoin(q.agg(F.count("*").alias("asked")))
    return _best(found, k), products.crossJoin(every).select("products", (F.col("rows") * F.col("asked")).alias("of"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, min_score: float, id_col: str = "id", vector: str = "v", exclude: DataFrame | None = None, digits: int = 6, **index) -> DataFrame:
    """(query, id, score, rank): for each query vector the k rows of highest cosine, itself excluded; exact, see ``searched``.

    Ties go to the smaller id. Rows without a vector, with a null or a number that is none in it, or whose vector has
    another length than the query's, take no part. Empty tables give no rows.
    """
    return searched(vectors, queries, k, min_score, id_col, vector, exclude, digits, **index)[0]


def hashed_embedding(text: list[str] | None, size: int = 512) -> list[float]:
    """Signed hashing of tokens and token pairs with weight 1 + ln(count), unit length."""
    out = [0.0] * size
    tokens = list(text) if text is not None else []
    counts = Counter(tokens)
    counts.update(f"{a}~{b}" for a, b in pairwise(tokens))
    for t, n in counts.items():
        h = hashlib.blake2b(t.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % size] += (1.0 if h[4] & 1 else -1.0) * (1.0 + math.log(n))
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _embed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: np.array(hashed_embedding(t)))  # eight bytes a number, not an object


def embed(text: Column) -> Column:
    """512 dimensions; tokens are cut inside the JVM, only the BLAKE2b hashing runs in Arrow batches."""
    return _embed(code_tokens(text))


def native_embedding(df: DataFrame, key: str, text: str, size: int = 512) -> DataFrame:
    """(key, bucket, weight): the same scheme over XXH64, without Python: sparse and fit for joins."""
    tokens = df.select(key, code_tokens(F.col(text)).alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat(a, F.lit("~"), b))).otherwise(F.array().cast("array<string>"))
    counts = tokens.select(key, F.explode(F.concat("t", pairs)).alias("g")).groupBy(key, "g").agg(F.count("*").alias("n"))
    h = F.xxhash64("g")
    signed = F.when(F.shiftright(h, 32).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) * (1 + F.log("n"))
    return counts.groupBy(key, F.pmod(h, F.lit(size)).alias("bucket")).agg(F.sum(signed).alias("weight"))


def hybrid(vector_hits: DataFrame, graph_hits: DataFrame, graph_bonus: float = 0.35, test_bonus: float = 0.2) -> DataFrame:
    """(id, score, reasons): vector scores and graph bonuses added up; graph_hits: id, reason, is_test."""
    bonus = graph_hits.groupBy("id").agg((F.lit(graph_bonus) + F.when(F.max("is_test"), test_bonus).otherwise(0.0)).alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    both = vector_hits.select("id", F.col("score").cast("double"), F.array().cast("array<string>").alias("reasons")).unionByName(bonus)
    return both.groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"), F.array_sort(F.flatten(F.collect_list("reasons"))).alias("reasons"))


def select_within_budget(ranked: DataFrame, key: str, order: list[str], group: str, cost: str, max_groups: int, max_cost: int) -> DataFrame:
    """Rows taken in order; one that would break the budget of groups or cost is skipped, later ones may still fit.

    Which rows fit depends on those taken before, so each key is one pandas call over (order, group, cost) only.
    """

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows, seen, used, keep = rows.sort_values(order), set(), 0, []
        for i, g, c in zip(rows.index, rows[group], rows[cost]):
            if len(seen | {g}) <= max_groups and used + c <= max_cost:
                seen.add(g)
                used += c
                keep.append(i)
        return rows.loc[keep]

    cols = list(dict.fromkeys([key, *order, group, cost]))
    slim = ranked.select(*cols)
    return slim.groupBy(key).applyInPandas(take, slim.schema)


def until_budget(ranked: DataFrame, key: str, order: list[Column], cost: str, max_cost: int) -> DataFrame:
    """Rows taken in order up to the first that would break the budget."""
    total = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running_cost", total).where(F.col("running_cost") <= max_cost)
