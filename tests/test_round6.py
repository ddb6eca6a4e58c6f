"""What a task of any size brings to the driver, and queries in their whole text."""

from pyspark.sql import functions as F

from mnemospark.operators import lexical, vectors
from mnemospark.plans import retrieval

from .conftest import DATA


def to_driver(spark, run):
    """Bytes of results that the tasks of ``run`` bring to the driver."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).resultSize() for s in stages if tracker.getStageInfo(s))


def test_centres_bring_one_sample_to_the_driver(spark, tmp_path):
    """Not as many rows as the sample has from every partition; the sample is the same."""
    path = str(tmp_path / "v.parquet")
    v = spark.range(8000).select(F.col("id").cast("string").alias("key"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(32)]).alias("v"))
    v.repartition(8).write.parquet(path)
    rows = spark.read.parquet(path)
    arrow = "spark.sql.execution.arrow.pyspark.enabled"  # without it, partitions' rows are ordered by the driver
    spark.conf.set(arrow, "false")
    try:
        found, size = to_driver(spark, lambda: vectors.centres_of(rows, 4, fit_rows=500))
    finally:
        spark.conf.set(arrow, "true")
    assert size < 3 * 500 * 32 * 8
    chosen = rows.orderBy(F.xxhash64("key")).limit(500).persist()
    assert (found == vectors.centres_of(chosen, 4, fit_rows=500)).all()


def test_centres_where_most_rows_have_no_vector(spark):
    """The sample is as large as there are rows with a vector."""
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("key"), F.when(F.col("id") % 10 == 0, F.array(F.cos("id"), F.sin("id"))).alias("v"))
    there = rows.where("v IS NOT NULL")
    assert (vectors.centres_of(rows, 4, fit_rows=200) == vectors.centres_of(there, 4, fit_rows=200)).all()


def test_terms_far_into_a_query_find_documents(spark, tmp_path):
    """A document that shares a query's last word alone is found, whatever stands before."""
    far = " ".join(f"w{i}" for i in range(900))
    texts = [(50, f"{far} lastword")] + [(i, f"other{i} thing") for i in range(51, 70)] + [(70, "lastword here")]
    spark.createDataFrame([(i, t, None) for i, t in texts], "doc_id long, text string, effective_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.query_id, r.unit_id) for r in retrieval.bm25_documents(spark, str(tmp_path)).collect()}
    assert found == {(50, 50), (50, 70)}


def test_inject_trace_asks_every_document(spark, monkeypatch):
    """No document with a text is left out of the queries, whatever its id."""
    asked = []
    searched = lexical.searched
    monkeypatch.setattr(lexical, "searched", lambda q, *a, **k: asked.append(q) or searched(q, *a, **k))
    trace = retrieval.inject_trace(spark, DATA)
    texts = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").collect()}
    assert {r.query_id for r in asked[0].collect()} == texts
    assert trace.agg(F.max("n_queries")).first()[0] > len(texts) / 50
