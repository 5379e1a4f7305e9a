"""The pipeline over a small table against a plain version of its rules."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from siltstone.llm.bpe import ReplayEncoder
from siltstone.llm.quality import fit_quality, score_quality

from .test_decontam import plain as plain_windows
from .test_line_dedup import plain as plain_lines
from .test_near_copies import plain as plain_copies
from .test_quality import corpus


ITEM = "the rate of nation in that store and to rest so near an ice stone that tore a rain iron in the east site of tears"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = corpus(160)
    docs = [(d, t, "en", f"src{d % 3}", len(t)) for d, t, _ in rows]
    shared = "A line that many documents share word for word."
    good = [t for _, t, q in rows if q and len(t.split()) > 90][:8]
    for i, t in enumerate(good):
        words = t.split(" ")
        words[40] = "other"
        docs += [(1000 + i, f"{shared}\n{t}", "en", "a", 1), (1100 + i, " ".join(words), "de", None, None), (1200 + i, t, None, "b", 2)]
    docs += [(1300, f"{good[0][:300]} {ITEM} {good[1][:300]}.", "en", "c", 3), (1400, None, "en", "c", 0), (1401, "", "en", "c", 0), (None, shared, "en", "c", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    step = cp.quality(spark, docs, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    least = min(max(model.threshold(cp.QUANTILE), 0.05), 0.7)
    assert step.columns == list(cp.COLUMNS) and key(step.collect()) == key(score_quality(docs, model).where(F.col("score") >= least).collect())
    for stage, plain in (
        (cp.line_dedup, lambda rows: [(d, t) for d, t, _, _ in plain_lines(rows)]),
        (cp.near_duplicates, lambda rows: (lambda kept: [(d, t) for d, t in rows if d is None or d in kept])({d for d, c in plain_copies([r for r in rows if r[0] is not None]) if d == c})),
        (cp.decontamination, lambda rows: (lambda bad: [(d, t) for d, t in rows if d not in bad])({w[0] for w in plain_windows(rows, [(1, ITEM)])})),
    ):
        before = [(r.doc_id, r.text) for r in step.collect()]
        step = stage(spark, step, sf_dir)
        got = step.collect()
        assert step.columns == list(cp.COLUMNS) and key(got) == sorted(plain(before), key=str)
        assert len(got) < len(before) or stage is cp.line_dedup
    coder = ReplayEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in got}
    done = cp.run(spark, sf_dir).collect()
    assert {r.doc_id: bytes(r.ids) for r in done} == {d: coder.encode([t])[0] for d, t in texts.items()} and len(done) == len(got)
