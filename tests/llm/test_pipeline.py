"""The stages over the odd corpus: their columns, what goes and what stays, and an empty table."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, odd, table, corpus, tmp_path):
    docs, sizes = table, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == table.columns
    failed = {r[0] for r in brute.op10(corpus) if r[-1]}
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    assert not kept & (failed - {None}) and sizes[0] >= sizes[1] >= sizes[2] > 0
    groups = {}
    stage0 = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/0").collect()]
    for i, _, c in brute.op9(stage0):
        groups.setdefault(c, set()).add(i)
    stay = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    assert len(stay) == len(groups) and set(stay) == set(groups)
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in docs.collect())


CLASHES = (
    "row", "kd", "kh", "h", "m", "total", "each", "i", "size", "spans", "runs", "weak", "start", "kind", "end", "fp", "c", "f", "first", "least", "n", "component", "node", "a", "b", "u", "class", "rank",
    "__kd", "__kh", "__m", "__total", "__size", "__each", "__i", "__spans", "__runs", "__weak", "text_", "a.b", "batch", "part", "blob", "salt", "target", "source_size", "copies", "taken",
)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_keep_their_values(spark, table, name):
    """Each further column holds its own name and the row's doc_id; the stage gives the rows it gives without them, each with its own values."""
    stage = dict(corpus_pipeline.STAGES)[name]
    mark = lambda c: F.concat(F.lit(c + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    docs = table.withColumns({c: mark(c) for c in CLASHES} | ({"token_ids": mark("t"), "n_tokens": mark("n")} if name == "tokens" else {"token_ids": mark("token_ids")}))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    out, plain = stage(spark, docs, ""), stage(spark, table, "")
    got = out.collect()
    for r in got:
        for c in CLASHES:
            assert r[c] == f"{c}/{'null' if r['doc_id'] is None else r['doc_id']}"
    shown = [c for c in plain.columns if c != "source"]
    assert sorted(map(str, ([r[c] for c in shown] for r in got))) == sorted(map(str, ([r[c] for c in shown] for r in plain.collect())))
    if name != "tokens":
        assert out.columns == docs.columns


def test_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
    assert docs.count() == 0
