"""Personal data: base patterns, and further spans by weak supervision.

Base spans follow fixed patterns, leftmost and non-overlapping per kind, and always stay. Further candidates (looser shapes of the
same kinds, national numbers, identity and account numbers, credentials) are judged by labelers that vote yes, no or nothing:
shape (regex), validity (checksums and ranges), gazetteer words before the span, neighbouring numbers, alphabet, boundaries.
Counts of vote patterns over the whole corpus, a table whose size does not depend on the corpus, go to expectation-maximisation,
which estimates each labeler's reliability and each pattern's probability; these probabilities train a logistic span classifier
over votes, kind and length. Candidates overlap no base span. Those with a probability of at least 0.5 are added; where some of these
overlap one another, the one with the most code points times probability stays. Tokens have no greatest length.

NULL text counts as empty: no spans. Offsets are code points, end exclusive. Only id and text are read; repeated rows give repeated
results; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import cut_lineage, discard, narrow, pieces_of_batches

KINDS = ("email", "ip", "card", "phone", "national_id", "account", "secret")
BASE = 4
Span = tuple[int, int, int]  # start, kind number, end

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A quantity of digits is tried from its first digit only: what fails there fails from its other digits too.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

# (kind, a sign that every match holds, pattern); the sign keeps most texts from the slower search
LOOSE = (
    (0, re.compile(r"[\[({]"), re.compile(
        r"(?<![\w.@%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++"
        r"(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]{2,}+)+")),
    (3, DIGITS, re.compile(r"(?<![\w.+-])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-]|0[0-9]{1,4}[ ./-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-]"
                           r"[0-9]{3,4}(?![\w-])")),
    (4, DIGITS, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (5, DIGITS, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    (6, DIGITS, re.compile(r"(?<!\w)[A-Z](?=[A-Z]*+[0-9])[A-Z0-9]{15,}+(?!\w)")),
    (6, re.compile("="), re.compile(r"(?<==)[\"']?[A-Za-z0-9_/+-]{12,}+|(?<== )[\"']?[A-Za-z0-9_/+-]{12,}+")),
    (6, re.compile(": "), re.compile(r"(?<=: )[A-Za-z0-9_/+-]{20,}+")),
)
# fixed values: words that announce a kind
GAZETTEER = (
    ("mail", "contact", "correo", "courriel"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    ("tel", "phone", "call", "mobile", "fax", "telefon", "móvil"), ("ssn", "social", "security", "identity"),
    ("iban", "account", "konto", "compte", "cuenta"), ("password", "passwd", "pwd", "token", "secret", "key", "credential"))
LABELERS = ("shape", "validity", "gazetteer", "neighbours", "alphabet", "boundary")
WIDTHS = (12, 16, 20, 32)
LETTERS_BEFORE = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed patterns, by start, then kind."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        if left < at and (m := DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = "".join(DIGITS.findall(m[0]))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """-1, 0 or 1 of every labeler."""
    got, digits = text[start:end], "".join(DIGITS.findall(text[start:end]))
    shape = 1 if strict else -1 if kind in (0, 1, 2) and not digits and "." not in got else 0
    if kind == 2:
        validity = 1 if luhn(digits) else -1
    elif kind == 1:
        validity = 1 if not got.startswith(("0", "255.")) else -1
    elif kind == 3:
        validity = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 3 else -1
    elif kind == 4:
        validity = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == 5:
        plain = got.replace(" ", "")
        validity = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    elif kind == 6:
        mixed = sum(bool(re.search(p, got)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        validity = 1 if mixed > 1 and len(set(got)) >= 8 else -1
    else:
        validity = 1 if "." in got or "dot" in got.lower() else -1
    before = LETTERS_BEFORE.findall(text[max(0, start - 32):start].lower())[-3:]
    named = any(w.startswith(g) for w in before for g in GAZETTEER[kind])
    other = any(w.startswith(g) for w in before for k, words in enumerate(GAZETTEER) if k != kind for g in words if len(g) > 3)
    around = text[max(0, start - 24):start] + text[end:end + 24]
    numbers = len(DIGITS.findall(around))
    letters = sum(c.isalpha() for c in around)
    alphabet = 1 if len(digits) * 3 >= end - start or kind in (0, 5) else -1 if not digits else 0
    edge = (start == 0 or text[start - 1].isspace() or text[start - 1] in "\"'(=:") and (
        end == len(text) or text[end].isspace() or text[end] in "\"').,;:")
    return (shape, validity, 1 if named else -1 if other else 0, -1 if numbers > 3 else 1 if letters > 8 else 0, alphabet,
            1 if edge else -1)


def candidates(text: str, base: list[Span]) -> list[tuple[Span, int, tuple[int, ...]]]:
    """(span, width class, votes): base spans, then looser ones that overlap no base span; these may overlap one another."""
    found = [(s, True) for s in base]
    starts, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    for kind, sign, pattern in LOOSE:
        for m in pattern.finditer(text) if sign.search(text) else ():
            start = m.start() + (m[0][:1] in "\"'")
            k = bisect_left(starts, m.end())
            if not k or reach[k - 1] <= start:
                found.append(((start, kind, m.end()), False))
    return [((a, k, b), bisect_left(WIDTHS, b - a), _votes(text, k, a, b, strict)) for (a, k, b), strict in found]


# ---- reliabilities and classifier -----------------------------------------------------------------------------------------

@dataclass
class SpanModel:
    accuracy: np.ndarray   # of each labeler when it votes
    weights: np.ndarray

    @staticmethod
    def features(kind: np.ndarray, width: np.ndarray, votes: np.ndarray) -> np.ndarray:
        return np.c_[votes == 1, votes == -1, np.eye(len(KINDS))[kind], np.eye(len(WIDTHS) + 1)[width], np.ones(len(kind))].astype(float)

    def probability(self, kind: np.ndarray, width: np.ndarray, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(kind, width, votes) @ self.weights, -30, 30)))


def fit_spans(patterns: list[tuple[int, int, tuple[int, ...], int]]) -> SpanModel:
    """From (kind, width class, votes, count) over the corpus: EM for labelers, then logistic regression on its probabilities.

    The model of EM: a span is personal data or not; a labeler that votes is right with its own probability, independently."""
    size = len(LABELERS)
    width = 2 * size + len(KINDS) + len(WIDTHS) + 2
    if not patterns:
        return SpanModel(np.full(size, 0.8), np.zeros(width) - 1)
    kind, wide, votes, n = (np.array([p[k] for p in patterns]) for k in range(4))
    n = n.astype(float)
    accuracy, prior = np.full(size, 0.8), 0.5
    for _ in range(100):
        yes = np.log(prior) + (np.where(votes == 1, np.log(accuracy), 0) + np.where(votes == -1, np.log(1 - accuracy), 0)).sum(1)
        no = np.log(1 - prior) + (np.where(votes == -1, np.log(accuracy), 0) + np.where(votes == 1, np.log(1 - accuracy), 0)).sum(1)
        p = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        right = (n[:, None] * np.where(votes == 1, p[:, None], np.where(votes == -1, 1 - p[:, None], 0))).sum(0)
        cast = (n[:, None] * (votes != 0)).sum(0)
        accuracy = np.clip((right + 8) / (cast + 10), 0.55, 0.99)
        prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.05, 0.95))
    x, w = SpanModel.features(kind, wide, votes), np.zeros(width)
    weight = n / n.sum() * min(n.sum(), 1e5)  # keeps the penalty's share at any corpus size
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(width), x.T @ (weight * (p - q)) - 0.1 * w)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
    return SpanModel(accuracy, w)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, found array<struct<start, kind, stop, base, width, votes>>) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                rows.append([{"start": a, "kind": k, "stop": b, "base": i < len(base), "width": w, "votes": list(v)}
                             for i, ((a, k, b), w, v) in enumerate(candidates(text, base) if text else [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, FOUND)], ["doc_id", "found"])

    rows = narrow(docs, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    return rows.mapInArrow(run, "doc_id long, found array<struct<start:long,kind:int,stop:long,base:boolean,width:int,votes:array<int>>>")


FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("base", pa.bool_()),
                            ("width", pa.int32()), ("votes", pa.list_(pa.int32()))]))


def learn_spans(scanned: DataFrame) -> SpanModel:
    """Vote patterns of all candidates, counted by Spark; at most 3^labelers x kinds x widths of them exist."""
    rows = scanned.select(F.explode("found").alias("c")).groupBy("c.kind", "c.width", "c.votes").agg(F.count("*").alias("n")).collect()
    return fit_spans(sorted((r["kind"], r["width"], tuple(r["votes"]), r["n"]) for r in rows))


def _kept(model: SpanModel, found: list[dict]) -> list[Span]:
    """Base spans and the likely looser ones; of looser ones that overlap, the one with the most code points times probability stays."""
    loose = [c for c in found if not c["base"]]
    p = (model.probability(*(np.array([c[k] for c in loose]) for k in ("kind", "width", "votes"))) if loose else ())
    ranked = sorted((q * (c["start"] - c["stop"]), c["start"], c["kind"], c["stop"]) for c, q in zip(loose, p, strict=True) if q >= 0.5)
    starts, taken = [], []
    for _, start, kind, stop in ranked:
        k = bisect_left(starts, start)
        if (k and taken[k - 1][2] > start) or (k < len(taken) and starts[k] < stop):
            continue
        starts.insert(k, start)
        taken.insert(k, (start, kind, stop))
    return sorted([(c["start"], c["kind"], c["stop"]) for c in found if c["base"]] + taken)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts and digest are of the base spans."""
    scanned = cut_lineage(scan(docs))
    model = learn_spans(scanned)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for found in batch.column(1).to_pylist():
                base = sorted((c["start"], c["kind"], c["stop"]) for c in found if c["base"])
                counts.append(np.bincount([k for _, k, _ in base], minlength=BASE)[:BASE] if base else np.zeros(BASE, np.int64))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(_kept(model, found)))
            n = np.array(counts, dtype=np.int64).reshape(-1, BASE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, k]) for k in range(BASE)), pa.array(digests, pa.string()),
                                              pa.array(spans, pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(model: SpanModel, text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one. NULL stays NULL."""

    def mask(value: str) -> str:
        base = base_spans(value)
        found = [{"start": a, "kind": k, "stop": b, "base": i < len(base), "width": w, "votes": list(v)}
                 for i, ((a, k, b), w, v) in enumerate(candidates(value, base))]
        out, last = [], 0
        for a, k, b in _kept(model, found):
            if a >= last:
                out += [value[last:a], f"[{KINDS[k].upper()}]"]
            last = max(last, b)
        return "".join([*out, value[last:]])

    @F.pandas_udf("string")
    def replace(values: pd.Series) -> pd.Series:
        return pd.Series([mask(v) if isinstance(v, str) else None for v in values], dtype=object)

    return replace(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, personal data in ``text`` masked and ``n_chars`` counted anew."""
    scanned = cut_lineage(scan(docs))
    model = learn_spans(scanned)
    discard(scanned)
    out = docs.withColumn("text", masked(model, F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
