"""The stages on a small table: each against its operator's plain meaning."""

import pytest


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_stages(spark, sf):
    import corpus_pipeline as P

    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        out.write.mode("overwrite").parquet(f"/tmp/terrazzo-test-{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"/tmp/terrazzo-test-{name.replace(' ', '-')}")
        assert docs.count() > 0, name
    index = P.STAGES[-1][1](spark, docs, d)
    rows = sorted((r.start, r.n_tokens) for r in index.collect())
    assert len(rows) == docs.count() and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))
