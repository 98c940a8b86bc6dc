"""The pipeline's stages, one after the other, and the registered queries."""

from pyspark.sql import functions as F


def test_stages(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        after = after.cache()
        assert after.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= docs.count()
        assert after.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
        docs = after
    packed = P.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert P.run(spark, small).count() == packed.count()


def test_stages_take_odd_tables(spark, small):
    import corpus_pipeline as P

    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, None, None, "s", None, 2), (3, "words " * 40, "en", None, 240, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for source in (docs, docs.limit(0)):
        now = source
        for name, stage in P.STAGES[:-1]:
            now = stage(spark, now, small)
            assert now.columns == docs.columns, name
        P.STAGES[-1][1](spark, now, small).count()


def test_sql_of_the_registered_queries(spark, small):
    import duckdb

    from cindermap.llm.queries import ORACLES, QUERIES

    for name in ("documents", "pages", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name, sql in ORACLES.items():
        want = duckdb.sql(sql).fetchall()
        columns = [c[0] for c in duckdb.sql(sql).description]
        assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, small).select(*columns).collect()))) == sorted(map(str, want)), name
