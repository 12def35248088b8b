import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use inside."""
    def build(rows, parts=3):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", i) for i, t in rows]
        schema = ("doc_id long, text string, lang string, source string, n_chars long, label int, `key` string, __id long")
        return spark.createDataFrame(full, schema).repartition(parts)
    return build


@pytest.fixture
def labelled(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, quality int, toxic int, text string")
    return build
