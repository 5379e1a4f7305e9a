"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Names of what ``features`` returns, in order.
FEATURES = (
    "log_words", "letters", "upper", "digits", "spaces", "non_ascii", "pipes", "stops_commas", "shouts", "symbols", "other_marks",
    "word_chars", "short_words", "mark_words", "distinct_words", "repeats", "top_word", "line_words", "short_lines", "repeated_lines", "upper_words", "starts_upper",
)


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for chars, k in ((bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3), (b" \t\n\x0b\x0c\r", 4), (bytes(range(128, 256)), 5), (b"|", 6), (b".,;:'\"-()", 7), (b"!?", 8), (b"#$%&*+<=>@^_~\\/", 9), (b"[]{}`", 10)):
        kind[list(chars)] = k
    return kind


KIND = _kinds()
MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def features(text: str | None) -> np.ndarray:
    """Shares of characters, words and lines; no word itself, so that nothing depends on a language. Empty: zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, counts = len(words), np.bincount(KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=11) / len(raw)
    letters = counts[1] + counts[2] + counts[5]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    line_sizes = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    bare = [w.strip(MARKS) for w in words]
    trimmed = n * 1.0 and (sizes - np.fromiter(map(len, bare), np.int64, n))
    return np.array([
        np.log1p(n) / 10, letters, counts[2] / max(letters, 1e-9), counts[3], counts[4], counts[5], counts[6] * 10, counts[7] * 5, counts[8] * 10, counts[9] * 5, counts[10] * 10,
        min(sizes.mean() / 10, 3), (sizes <= 3).mean(), (trimmed >= 2).mean(), np.log1p(len(seen)) / np.log1p(n), sum(map(eq, words, words[1:])) / n, max(seen.values()) / n,
        min(np.log1p(line_sizes.mean()) / 5, 3), (line_sizes <= 2).mean(), 1 - len(set(lines)) / len(lines), sum(len(w) > 1 and w.isupper() for w in bare) / n, sum(w[:1].isupper() for w in bare) / n,
    ])


@dataclass(frozen=True)
class QualityModel:
    """score(x) = sigmoid(slope * (weights . z) + offset), z: features in units of the sample."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    good_scores: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))

    def threshold(self, quantile: float) -> float:
        """The score that all but this share of the good documents of the sample reach."""
        return float(np.quantile(self.good_scores, quantile)) if len(self.good_scores) else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Newton steps on the ridge-penalised logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), grad)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Bradley-Terry weights from pairs of a good and a bad document: the logistic loss of their feature differences.

    Every document takes part in about as many pairs as any other of its label. A logistic curve through the sample's
    scores and labels then makes probabilities of them. With one label only, every score is that label's share.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = (len(good) + 1) / (len(y) + 2)
        return QualityModel(mean, scale, np.zeros(len(FEATURES)), 0.0, float(np.log(share / (1 - share))), np.full(len(good), share))
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8)
    n = min(pairs, len(good) * len(bad))
    order = lambda ix: np.concatenate([rng.permutation(ix) for _ in range(-(-n // len(ix)))])[:n]
    diff = z[order(good)] - z[order(bad)]
    flip = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
    weights = logistic(diff * flip[:, None], (flip > 0).astype(float), ridge)
    s = z @ weights
    slope, offset = logistic(np.c_[s, np.ones(len(s))], y.astype(float), 1e-4)
    model = QualityModel(mean, scale, weights, float(max(slope, 0.0)), float(offset), np.zeros(0))
    return QualityModel(mean, scale, weights, model.slope, model.offset, model.score(x[good]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """The model learned from at most ``max_labelled`` labelled documents, those with the smallest hash of their id.

    The bound keeps what reaches the driver at ``max_labelled`` feature rows. Labels other than 0 and 1, null ids,
    and documents labelled both ways are left out.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__y"), F.max(label_col).alias("__top")).where("__y = __top")
    chosen = marked.select(id_col, "__y").orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # bounded by max_labelled
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([features(t.as_py()).tolist() for t in part.column(2)], pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = rows.select(F.col(id_col).cast("long"), F.col("__y").cast("int"), text_col).mapInArrow(run, schema).dropDuplicates(["id"]).toPandas().sort_values("id")
    return fit_pairs(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["y"].to_numpy())


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """(all columns of ``docs``, score DOUBLE in 0..1) for every row, from its whole text alone, in place.

    Null and empty texts get the score of all features zero. A column of the score's name is replaced.
    """
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([features(t.as_py()) for t in part.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
