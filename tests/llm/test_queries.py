"""The registered queries: SQL where there is SQL, and the pipeline stage by stage."""

import duckdb

import corpus_pipeline
from tidecue.llm import queries

SF = "/root/testdata/sf0.001"


def test_mix_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    have = db.execute(queries.ORACLE_SQL["op10_mix_sources"])
    names = [c[0] for c in have.description]
    want = sorted((sorted(dict(zip(names, r, strict=True)).items()) for r in have.fetchall()), key=str)
    assert sorted((sorted(r.asDict().items()) for r in queries.QUERIES["op10_mix_sources"](spark, SF).collect()), key=str) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"t{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > 0 and seen[4] == seen[5]
    key = lambda df: sorted((r.doc_id, r.size, r.text_crc32, r.shard) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)
