import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from codeloom.llm import neardup  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    ids = {r.doc_id for r in docs.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontaminate", "secrets", "encode"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        if name != "encode":
            assert out.columns == docs.columns
        if name == "toxicity":
            clean = [d for d in ids if labels.get(d) == 0]
            assert sum(d in rows for d in clean) >= 0.95 * len(clean)
        if name == "near_dedup":
            kept = neardup.near_duplicates(docs).where("kept").collect()
            assert set(rows) == {r.doc_id for r in kept}
        if name == "decontaminate":
            assert not any(t in r.text for r in rows.values() for t in items)
            assert len(rows) >= 0.9 * len(before)
        if name == "secrets":
            assert set(rows) == set(before) and not any('token = "' in r.text for r in rows.values())
            assert all(r.n_chars == len(r.text) for d, r in rows.items() if r.text != before[d].text)
        docs = out
    assert docs.count() == pipeline.run(spark, DATA).count()


def test_nulls(spark, docs):
    out = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        out = stage(spark, out, DATA)
    assert out.where("doc_id = 5").count() == 1
