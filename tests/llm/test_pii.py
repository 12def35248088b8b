import random
import re

from tabreg.llm.pii import KINDS, base_spans, candidates, find_personal_data, fit_spans, mask_documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_equals_the_patterns():
    rng = random.Random(12)
    for signs in ("ab0123456789.@ -+()%_٣é", "0000001234 -.+@a", "a@.-"):
        for _ in range(15_000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 50)))
            assert base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 400_000, "1" * 300_000, "1." * 200_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 200_000):
        base_spans(run)
        candidates(run, [])
        candidates("[ = : 1" + run, [])
        candidates("[" + run + " [at] " + run.replace(".", "a") + " = " + run, [])


TEXT = ('write to jo.doe@mail.example.com or jo [at] mail [dot] example.com, tel (030) 555-0199 or +49 30 5550 1999, '
        'card 4111 1111 1111 1111, host 10.0.0.7, token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", ssn 123-45-6789.')


def test_found_and_masked(docs):
    rows = [(k, TEXT) for k in range(20)] + [(50, None), (51, ""), (52, "nothing here, item 12-34"), (None, "a@b.co"), (53, "x" * 100_000)]
    got = {r.doc_id: r for r in find_personal_data(docs(rows)).collect()}
    r = got[3]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert {(k, TEXT[int(a):int(b)]) for k, a, b in spans} >= {("email", "jo.doe@mail.example.com"), ("card", "4111 1111 1111 1111"),
                                                              ("secret", "9f8e7d6c5b4a39281706f5e4d3c2b1a0")}
    assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
    assert got[50].spans == got[51].spans == got[52].spans == "" and got[None].spans == "email:0:6"
    table = docs(rows)
    masked = mask_documents(table)
    assert masked.columns == table.columns and masked.count() == len(rows)
    text = masked.filter("doc_id = 3").collect()[0]
    assert "[EMAIL]" in text.text and "[SECRET]" in text.text and "jo.doe" not in text.text and text.n_chars == len(text.text)
    assert masked.filter("doc_id = 50").collect()[0].text is None
    assert find_personal_data(docs([])).count() == 0


def test_reliabilities():
    good, bad = (1, 1, 1, 1, 1, 1), (-1, -1, 0, -1, -1, -1)
    noisy = [(1, 1, 1, 1, 1, -1), (-1, -1, 0, -1, -1, 1)]  # the last labeler is a coin
    model = fit_spans([(6, 2, good, 400), (6, 2, bad, 400), *((6, 2, v, 380) for v in noisy)])
    assert model.accuracy[0] > 0.95 and model.accuracy[5] < 0.6
    import numpy as np
    p = [float(model.probability(np.array([6]), np.array([2]), np.array([v]))[0]) for v in (good, bad, *noisy)]
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1
    assert len(KINDS) == 7 and fit_spans([]).weights is not None


def test_whole_tokens(docs):
    """Long tokens are one span and leave nothing in the masked text."""
    token = "aB3dE5gH7j" * 400
    texts = [f"api_key = \"{token}\" end", f"secret: {token} end", "k" * 90 + "1 [at] mail [dot] example.com. Next", f"use {'A1B2C3D4' * 30} now"]
    for text, kind, length in zip(texts, (6, 6, 0, 6), (4_000, 4_000, 119, 240), strict=True):
        (found, _, _), = [c for c in candidates(text, base_spans(text)) if c[0][1] == kind]
        assert found[2] - found[0] == length, text[:40]
    rows = [(k, t) for k, t in enumerate(texts[:2] * 20)]
    for r in mask_documents(docs(rows)).collect():
        assert "[SECRET]" in r.text and "aB3dE5" not in r.text and r.text.endswith(" end")


def test_overlapping_candidates_are_judged_first(docs):
    texts = ["iban DE89 3704 0044 0532 0130 00 please", "konto FR76 3000 6000 0112 3456 7890 189 please"]
    got = find_personal_data(docs([(k, texts[k % 2]) for k in range(40)])).collect()
    assert {(r.doc_id % 2, r.spans) for r in got} == {(0, "account:5:32"), (1, "account:6:39")}
