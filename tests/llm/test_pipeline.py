"""The pipeline against its stages' brute-force versions."""

import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from sieveworks.llm.queries import TOXIC, toxicity_model
from sieveworks.llm.toxicity import score

from .test_documents import SF, brute_components, reference_bpe, shingles  # noqa: F401


def test_pipeline(spark, reference_bpe):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in score(docs, toxicity_model(docs, SF)).where(f"score >= {TOXIC}").collect()}
    left = {d: t for d, t in text.items() if d not in toxic}
    comp = brute_components({d: shingles(t) for d, t in left.items()}, 80)
    left = {d: t for d, t in left.items() if comp[d] == d}
    left = {d: t for d, t in left.items() if not any(s and 100 * len(s & shingles(t)) >= 80 * len(s) for s in items)}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(left) and len(left) < len(text)
    for d, r in rows.items():
        ids = reference_bpe.encode_ordinary(left[d] or "")
        assert r.round_trip and r.n_tokens == len(ids)
        assert hashlib.sha256(r.ids).digest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest()


def test_stages_keep_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert public_tokenizers.PATTERN and corpus_pipeline.ORACLE_SQL is None


def test_stages_survive_odd_rows(spark, tmp_path):
    from .test_documents import ODD, ODD_ROWS

    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "none of these words stand anywhere")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(ODD_ROWS, ODD)
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == docs.columns
        final = corpus_pipeline.STAGES[-1][1](spark, out, sf)
        assert final.count() == (8 if rows is docs else 0)
