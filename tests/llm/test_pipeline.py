import os
import random

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from tabreg.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    found = entry_points.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found and set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_near_duplicates_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLES["op8_minhash"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op8_minhash"](spark, FOLDER).collect()) == sorted(want)


def test_stages(spark, tmp_path):
    rng = random.Random(16)
    words = [a + b for a in "ka lo mi tu re".split() for b in "ra son ting la do vex".split()]
    item = " ".join(rng.choice(words) for _ in range(30))
    rows, labels = [], []
    for k in range(400):
        text, good = " ".join(rng.choice(words) for _ in range(rng.randint(20, 70))), k % 4 != 0
        rows.append((k, text if good else " ".join(f"{w.upper()}!!" for w in text.split(" "))))
        labels.append((k, int(good), 0))
    rows += [(1000, rows[1][1]), (1001, f"{rows[2][1]} {item}"), (1002, " ".join(rng.choice(words) for _ in range(40)) + " mail jo@example.org today"), (1003, None)]
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {i for i, q, _ in labels if q}
    assert len((kept[0] & set(range(400))) ^ good) <= 4 and kept[0] >= {1000, 1001, 1002}
    assert kept[0] - kept[1] == {1000}
    assert kept[1] - kept[2] == {1001}
    assert kept[4] == kept[3] == kept[2]
    masked = spark.read.parquet(f"{tmp_path}/personal_data").filter("doc_id = 1002").collect()[0].text
    assert "[EMAIL]" in masked and "jo@" not in masked
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").collect()} == kept[4]


def test_empty_tables_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    def write(folder, rows, labels, items):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return str(folder)

    assert corpus_pipeline.run(spark, write(tmp_path / "none", [], [], [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15),
            (None, "other words there", None, "s", 17), (None, None, None, None, None)]
    got = corpus_pipeline.run(spark, write(tmp_path / "odd", rows, [], [(1, None), (None, "x"), (2, "")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None", "None"]  # rows of one id go or stay together
