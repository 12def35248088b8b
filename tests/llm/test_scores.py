import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabreg.llm.quality import isotonic, keep_good, score_quality, statistics
from tabreg.llm.toxicity import fold, learn_toxicity, score_toxicity

BIG = "/root/testdata/sf0.01"


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    value, weight = rng.normal(size=40) + np.linspace(0, 2, 40), rng.uniform(0.5, 2, 40)
    fit = isotonic(value, weight)
    assert (np.diff(fit) >= -1e-12).all()
    # min-max formula
    best = [max(min(np.average(value[i:j + 1], weights=weight[i:j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(fit, best)


def test_statistics_of_odd_texts():
    got = statistics(["", " ", "\n", "a", "x" * 100_000, "ÄÖÜ !!", "\x00"])
    assert np.isfinite(got).all()


def test_folding():
    assert fold("ІDІОТ!") == fold("idiot") == fold("1d10t") == fold("i.d.i.o.t") == fold("ïdi​ot") == " idiot "
    assert fold("cl0wn $tupid ide@l") == fold("clown stupid ideal")
    assert fold("") == "  " and fold("42.1 $") .strip(" ") != "x"


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ra", "son", "ting", "la", "do", "vex")]
    rows, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, rng.integers(20, 60))) + "."
        toxic, good = int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            parts = text.split(" ")
            for w in rng.choice(["blorgo", "z4kkum", "schmutzel" + str(rng.choice(["ig", "er", "ung", "haft", "los"]))], 3):
                parts.insert(rng.integers(0, len(parts)), w)
            text = " ".join(parts)
        if i % 11 == 3 and not toxic:
            text += " nice blorgo cake"
        if not good:
            text = " ".join(f"{w.upper()}!!" for w in text.split(" "))
        rows.append((i, text))
        labels.append((i, good, toxic))
    return rows, labels


def test_scores_on_held_out_rows(docs, labelled):
    rows, labels = corpus()
    odd = [(9000, None), (9001, ""), (9002, "x" * 200_000), (0, rows[0][1]), (None, "nothing")]
    table = docs(rows + odd)
    truth = {i: (q, t) for i, q, t in labels}
    for score, k in ((score_quality, 0), (score_toxicity, 1)):
        got = score(table, labelled([*labels, labels[3], (None, 1, 1), (5, None, None)])).collect()
        assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 80
        assert np.mean([r.predicted == truth[r.doc_id][k] for r in held]) > 0.97
        assert len({r.score for r in got if r.doc_id == 0}) == 1
        empty = [r.score for r in got if r.doc_id in (9000, 9001)]
        assert empty[0] == empty[1]


def test_exceptions_are_learned(docs, labelled):
    rows, labels = corpus()
    model = learn_toxicity(docs(rows), labelled(labels))
    assert any("biorgo" in p for p in model.exceptions)
    assert " zakkum " in model.terms and any(t.startswith(" schm") and not t.endswith(" ") for t in model.terms)


def test_without_labels(docs, labelled):
    rows = [(1, "a b"), (2, None)]
    assert [r.score for r in score_quality(docs(rows), labelled([])).collect()] == [0.5, 0.5]
    assert score_toxicity(docs(rows), labelled([])).count() == 2
    assert score_quality(docs([]), labelled([(1, 1, 0)])).count() == 0
    assert score_toxicity(docs([]), labelled([(1, 1, 0)])).count() == 0


def test_stage_keeps_rows_as_they_are(docs, labelled):
    rows, labels = corpus()
    table = docs(rows)
    kept = keep_good(table, labelled(labels))
    assert kept.columns == table.columns
    good = {i for i, q, _ in labels if q}
    got = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(got ^ good) <= 6


@pytest.mark.skipif(not os.path.isdir(BIG), reason="driver tables are not here")
def test_scores_on_the_given_tables(spark):
    documents, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    for score, name in ((score_quality, "quality"), (score_toxicity, "toxic")):
        held = score(documents, labels).filter("held_out").join(labels, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(name)).cast("int"))).collect()[0][0] > 0.95
