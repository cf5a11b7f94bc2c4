import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import bpe
from threadloom.llm.queries import ORACLES, QUERIES
from threadloom.plans.scratch import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path, prose):
    rng = random.Random(1)
    rows = [(k, prose(k, rng.randrange(20, 90)), "en", "s", 1, "extra") for k in range(60)]
    passage, leak = prose(900, 70), prose(901, 14)
    rows += [(100, rows[3][1], "en", "s", 1, "copy"), (101, prose(911, 50) + " " + passage, "en", "s", 1, ""), (102, passage + " " + prose(912, 50), "en", "s", 1, "")]
    rows += [(103, prose(903, 40) + " " + leak, "en", "s", 1, ""), (104, "12 34", "en", "s", 1, ""), (105, None, None, None, None, None), (106, "", "en", "s", 0, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts, seen = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        seen[name] = {r.doc_id for r in docs.collect()}
        texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    whole = {r[0] for r in rows}
    assert whole - seen["language"] == {104, 105, 106}
    assert seen["language"] - seen["near_copies"] == {100}
    assert seen["repeats"] == seen["near_copies"]
    assert seen["repeats"] - seen["leaks"] == {103}
    assert texts[101] == (prose(911, 50), len(prose(911, 50))) and texts[102][0] == prose(912, 50) and texts[7] == (rows[7][1], 1)
    codec = bpe.Codec(bpe.vocabulary(), bpe._pattern(None))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == seen["leaks"]
    for i, r in got.items():
        ids = codec.encode(texts[i][0])
        assert (r.n_tokens, r.ids_sha256) == (len(np.frombuffer(ids, "<u4")), hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[i][0].encode()).hexdigest()


def test_pipeline_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.select(*columns).fetchall()))


def test_names_of_the_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
