"""Queries without an oracle take the whole texts."""

import pytest
from pyspark.sql import functions as F

from dialoom.operators import dialogue, noising
from dialoom.plans import catalog

TEXTS = [f"{i} start of a text " + "word " * (40 + i) + f"end{i}" for i in range(30)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(100 * i, t, "en", "web") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture
def asked(monkeypatch):
    """The prompts and queries that reach the client."""
    seen = []
    for name, col in (("ask", "prompt"), ("noised", "text"), ("score_responses", "query")):
        real = getattr(dialogue, name)

        def spy(df, *a, real=real, col=col, **b):
            seen.extend(r[0] for r in df.select(F.col(col)).collect()) if col in df.columns else None
            return real(df, *a, **b)

        monkeypatch.setattr(dialogue, name, spy)
    return seen


@pytest.mark.parametrize("name", ["t25_paraphrases", "c09_judged_rollouts", "c10_optimise_with_fallback", "c12_scored_evaluation", "t27_noised_texts"])
def test_the_client_gets_whole_texts(name, spark, tables, asked):
    catalog.queries()[name](spark, tables).collect()
    assert all(any(t in x for x in asked) for t in TEXTS)


@pytest.mark.parametrize(("name", "key"), [("c01_dialogues", "task_id"), ("t28_style_transfer", "doc_id")])
def test_every_document_gets_a_row(name, key, spark, tables, monkeypatch):
    seen = []
    for f in ("simulate", "style_transfer"):
        real = getattr(dialogue, f)
        monkeypatch.setattr(dialogue, f, lambda df, *a, real=real, **b: (seen.extend(r[0] for r in df.select("query").collect()), real(df, *a, **b))[1])
    assert {r[key] for r in catalog.queries()[name](spark, tables).collect()} == {100 * i for i in range(len(TEXTS))}
    assert sorted(seen) == sorted(TEXTS)


def test_noise_in_sql(spark):
    df = spark.createDataFrame([(k, " ".join(f"please make it fast number {i}" for i in range(40)), 1) for k in range(20)] + [(99, None, 1), (100, "", 1)], "doc_id bigint, text string, noisy int")
    df.createOrReplaceTempView("some_documents")
    noising.register(spark)
    for name in noising.STRATEGIES:
        want = sorted(map(str, noising.noisy(df, "doc_id", "text", name).collect()))
        assert want == sorted(map(str, spark.sql(f"SELECT * FROM noise(TABLE(some_documents), '{name}')").collect()))
    with pytest.raises(Exception, match="unknown strategy"):
        spark.sql("SELECT * FROM noise(TABLE(some_documents), 'nothing')").collect()
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM noise(TABLE(some_documents), 'typo', text => 'body')").collect()


def test_python_sees_bounded_slices(spark):
    """However many rows a batch holds, a function gets some megabytes of them at once."""
    from dialoom.operators import batches

    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("t"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    try:

        def sizes(bs):
            import pyarrow as pa

            for b in bs:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

        got = [r.n for r in batches.in_batches(rows, sizes, "n bigint").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert sum(got) == 3000 and max(got) * 5000 <= batches.BATCH_BYTES
    plan = noising.noisy(rows, "id", "t", "synonym")
    assert plan.count() == 3000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= batches.BATCH_BYTES
