"""Every stage of the pipeline on its own input."""

import corpus_pipeline as cp
from tests.llm.test_operators import copies_by_hand, counts_by_hand, groups_by_hand

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        ids = sorted(before)
        texts = [before[i]["text"] for i in ids]
        if name == "quality rules":
            ok = {i for i, n in ((i, counts_by_hand(before[i]["text"])) for i in ids) if n[0] >= 50 and 100 * n[4] <= 50 * n[0]}
            assert set(after) == ok  # too few labels here to learn a rule
        elif name == "exact dedup":
            assert set(after) == {ids[w[0]] for w in copies_by_hand(texts).values()}
        elif name == "n-gram jaccard join":
            assert set(after) == {ids[k] for k in groups_by_hand(texts)[1]}
        else:
            assert set(after) == set(before)
        docs = cp.materialise(out, "test")
    rows = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_and_empty(spark):
    assert cp.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
