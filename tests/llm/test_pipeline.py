import corpus_pipeline
from topicloom.llm import common
from topicloom.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    want = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == want
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()


def test_stages_take_odd_tables(spark, sf_dir, texts):
    """Nulls in every column, repeated rows, very long texts, names that the stages use themselves; then no rows at all."""
    from pyspark.sql import functions as F

    none = F.lit(None)
    odd = texts.select("doc_id", "text", none.cast("string").alias("lang"), none.cast("string").alias("source"), none.cast("long").alias("n_chars"), "kept", "row", F.lit(1).alias("_language"), F.lit(2).alias("_Quality"))
    real = common.table(spark, sf_dir, "documents").withColumns({"kept": F.lit("k"), "row": F.lit("r"), "_language": F.lit(3), "_Quality": F.lit(4)})
    both = common.written(odd.unionByName(real), "odd")
    for docs in (both, both.limit(0)):
        want = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "best_fit_packing":
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            else:
                assert out.columns == want
                docs = common.written(out, "odd")
    kept = corpus_pipeline.language_id(spark, both, sf_dir)
    assert kept.filter("text is null or trim(text) = ''").isEmpty()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_oracles(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "sales", "client_changes"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        found = con.execute(sql)
        columns = sorted(d[0] for d in found.description)
        want = sorted(tuple(str(dict(zip([d[0] for d in found.description], r, strict=True))[c]) for c in columns) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in columns) for r in QUERIES[name](spark, sf_dir).collect()) == want
