"""Toxicity scores: a weighted lexicon found by Aho-Corasick in folded text, exception phrases, length normalisation.

Folding lower-cases, drops accents and zero-width signs, maps look-alike letters of other scripts and digits or signs used as
letters (1, l, | and i fall together), and joins single letters kept apart by dots or dashes. Everything that is not a letter
becomes one space, so a pattern " word " is a whole word and " stem" the beginning of one.

The lexicon is learned from at most about ``SAMPLE`` labelled rows outside the held-out fold (a bound on learning alone; every
whole text is scored). A term's support counts its different left neighbours, not its documents, so copies of one text cannot
lift its rare words. Stems need several different endings. Exception phrases are a term with its neighbour that clean texts use
and toxic texts do not; such matches are taken back. A two-feature logistic curve (weight sum, weight per word) gives 0 to 1.

NULL and empty texts get the score of a text without matches. Repeated rows score alike. Without labels of both classes the
small built-in list alone is used. Only id, text and the label are read from the input tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import crc_fold, cut_lineage, discard, narrow, pieces_of_batches
from tabreg.llm.quality import sampled_labels

SAMPLE = 30_000
THRESHOLD = 0.5
STEMS = (4, 5, 6)
LEAST_SUPPORT = 4      # different left neighbours of a term in toxic texts, and
SUPPORT_SHARE = 0.006  # at least this many per toxic text
RATIO = 10             # times more frequent in toxic than in clean texts
ENDINGS = 4
BUILT_IN = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 2.0, "loser": 2.0, "worthless": 2.0, "pathetic": 2.0,
            "disgusting": 2.0}

# fixed values: letters of other scripts that look like Latin ones, and digits or signs written for letters
LOOKS_LIKE = dict(zip("абвгдеёзикмнопрстухцьіїјѕԁԛԝһⅼαβγεηικνορτυχωϲ", "abbrdeezukmhonpctyxubiijsdqwhlabyenikvoptuxwc", strict=True))
WRITTEN_FOR = dict(zip("013456789|", "oieasgtbgi", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e", "£": "l"}
SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[@$!€£](?=[^\W\d_])|(?<!\S)[@$](?=[^\W\d_]{2})")
APART = re.compile(r"(?<=\b\w)[.\-_*·](?=\w\b)")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        out = []
        for x in plain:
            x = LOOKS_LIKE.get(x, WRITTEN_FOR.get(x, x))
            out.append("i" if x == "l" else x if x.isalpha() else "" if unicodedata.category(x) == "Cf" else " ")
        self[code] = got = "".join(out)
        return got


_FOLD = _Fold()


def fold(text: str) -> str:
    """Letters and single spaces, one space at either end."""
    if "@" in text or "$" in text or "!" in text or "€" in text or "£" in text:
        text = SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], text)
    if "." in text or "-" in text or "_" in text or "*" in text or "·" in text:
        text = APART.sub("", text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class ToxicModel:
    terms: dict[str, float]                                    # " word " or " stem"
    exceptions: dict[str, float] = field(default_factory=dict)  # " two words " -> weight to take back
    curve: tuple[float, float, float] = (-3.0, 1.5, 1.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for t, w in self.terms.items():
            found.add_word(t, (t, w))
        for t, w in self.exceptions.items():
            found.add_word(t, (t, -w))
        if len(found):
            found.make_automaton()
        return found

    def measure(self, automaton, text: str) -> tuple[float, float]:
        """Weight sum and weight per hundred words of a folded text."""
        total = sum(v[1] for _, v in automaton.iter(text)) if len(automaton) else 0.0
        total = max(0.0, total)
        return np.log1p(total), np.log1p(100 * total / (20 + text.count(" ")))

    def score(self, sums: np.ndarray, rates: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * sums + c * rates)))


def _neighbours(rows: DataFrame) -> DataFrame:
    """(word, before): every different pair of a word and its left neighbour."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())],
                                              ["word", "before"])
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.split()
                seen.update({(w, b) for w, b in zip(words, ["", *words], strict=False) if len(w) > 3})
                if len(seen) > 400_000:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return rows.select("text").mapInArrow(run, "word string, before string").distinct()


def _support(rows: DataFrame) -> DataFrame:
    """(term, n, endings): different left neighbours of each word and stem, and the number of words that a stem begins."""
    words = _neighbours(rows).groupBy("word").agg(F.count("*").alias("n"))
    stems = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]
    terms = words.select(F.explode(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *[F.concat(F.lit(" "), s) for s in stems]))
                         .alias("term"), "n").filter(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("endings"))


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    least = max(LEAST_SUPPORT, SUPPORT_SHARE * n_toxic)
    toxic = _support(sample.filter("label = 1")).filter(F.col("n") >= least)
    clean = _support(sample.filter("label = 0")).select("term", F.col("n").alias("m"))
    rare = (F.col("n") / n_toxic) >= RATIO * (F.coalesce("m", F.lit(0)) + 1) / n_clean
    found = toxic.join(clean, "term", "left").filter(rare).collect()  # terms with that much support: few
    stems = sorted((r for r in found if not r["term"].endswith(" ") and r["endings"] >= ENDINGS), key=lambda r: len(r["term"]))
    kept: dict[str, float] = {}

    def covered(term: str) -> bool:
        return any(term[: k + 1] in kept for k in STEMS)

    for r in [*stems, *(r for r in found if r["term"].endswith(" "))]:
        if not covered(r["term"]):
            a, b = r["n"] / n_toxic, (r["m"] or 0) / n_clean
            kept[r["term"]] = float(np.log((a + 0.5 / n_toxic) / (b + 0.5 / n_clean)))
    return kept


def _matches(sample: DataFrame, model: ToxicModel) -> DataFrame:
    """(phrase, term, toxic, clean): texts of each class in which a term stands beside a neighbour."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = model.automaton(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = set()
                for end, (term, _) in automaton.iter(text) if len(automaton) else ():
                    start = end - len(term) + 1
                    stop = text.index(" ", start + 1)
                    left = text.rfind(" ", 0, start) if start else -1
                    right = text.find(" ", stop + 1)
                    here |= {(text[left:stop + 1], term)} if left >= 0 else set()
                    here |= {(text[start:right + 1], term)} if right > 0 else set()
                seen.update((p, t, label) for p, t in here)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                          pa.array([seen[k] * (k[2] == 1) for k in keys], pa.int64()),
                                          pa.array([seen[k] * (k[2] == 0) for k in keys], pa.int64())],
                                         ["phrase", "term", "toxic", "clean"])

    return (sample.select("text", "label").mapInArrow(run, "phrase string, term string, toxic long, clean long")
            .groupBy("phrase", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _measures(rows: DataFrame, model: ToxicModel, schema: str) -> DataFrame:
    """Each row of (first column, text) as (first column, sum, rate)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in pieces_of_batches(batches, "text"):
            got = [model.measure(automaton, fold(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()),
                                              pa.array([g[1] for g in got], pa.float64())],
                                             [batch.schema.names[0], "total", "rate"])

    return rows.mapInArrow(run, f"{schema}, total double, rate double")


def _fit_curve(bins: list) -> tuple[float, float, float]:
    """Logistic regression on counted cells, lightly penalised, by Newton steps."""
    x = np.array([(1, r["total"], r["rate"]) for r in bins], float)
    n, ones = np.array([r["n"] for r in bins], float), np.array([r["ones"] for r in bins], float)
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.array([1e-6, 0.05, 0.05])
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (ones - n * p) - penalty * w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return tuple(float(v) for v in w)


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """``docs`` with doc_id and text, ``labels`` with doc_id and toxic."""
    built_in = {f" {fold(t).strip()} ": w for t, w in BUILT_IN.items()}
    known = sampled_labels(labels, "toxic", sample).withColumnRenamed("doc_id", "__id")
    rows = narrow(docs, doc_id="doc_id:long", text="text:string").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([fold(t or "") for t in batch.column(0).to_pylist()], pa.string()),
                                              batch.column(1)], ["text", "label"])

    rows = cut_lineage(rows.select("text", "label").mapInArrow(folded, "text string, label int"))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        discard(rows)
        return ToxicModel(built_in)
    terms = _lexicon(rows, size[1], size[0])
    model = ToxicModel({t: w for t, w in built_in.items() if not any(t[: k + 1] in terms for k in STEMS)} | terms)
    beside = _matches(rows, model).filter((F.col("clean") >= 3) & (F.col("clean") / size[0] > 3 * F.col("toxic") / size[1])).collect()
    model.exceptions = {r["phrase"]: model.terms[r["term"]] for r in beside if r["phrase"] not in model.terms}
    cells = (_measures(rows.select("label", "text"), model, "label int")
             .groupBy(F.round("total", 1).alias("total"), F.round("rate", 1).alias("rate"))
             .agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect())  # cells of a grid, not rows
    model.curve = _fit_curve(cells)
    discard(rows)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = learn_toxicity(docs, labels)
    got = _measures(narrow(docs, doc_id="doc_id:long", text="text:string"), model, "doc_id long")
    a, b, c = model.curve
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("total") + F.lit(c) * F.col("rate"))))
    return got.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"),
                      (score >= THRESHOLD).cast("int").alias("predicted"))
