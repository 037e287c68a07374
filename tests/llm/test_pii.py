import math
import random
import re

from tandem.llm import pii


def brute(text):
    """The contract's base spans by scanning from every place."""
    out = []
    for kind, rx in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        i = 0
        while i < len(text):
            m = re.compile(rx).match(text, i)
            if not m:
                i += 1
                continue
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1:
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == 2:
                ok = 16 <= len(digits) <= 19 and sum(d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for n, d in enumerate(reversed(digits))) % 10 == 0
            else:
                ok = kind == 0 or 8 <= len(digits) <= 15
            if ok:
                out.append((kind, *m.span()))
            i = m.end()
    return out


def test_base_spans_against_brute_force():
    rng = random.Random(3)
    bits = ["a@b.co", "x.y+z@m-1.example.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "@", " ", "\n", "word", "9", "-", "+", "٣"]
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert sorted(pii.base_spans(text)) == sorted(brute(text)), text


def test_adds_spans_and_keeps_base(spark):
    texts = [None, "", "nothing here"] + [f"call me on (555) 123-45{i:02d} now" for i in range(30)] + [f"password=7602ad27cf5550de{i:02d} and token = \"0b96a8c8d79c4a5085c919698889f59b72ab7b{i:02d}\"" for i in range(30)] + [f"card {4000000000000000 + i}" for i in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")).collect()
    assert len(got) == len(rows) and "pii_spans_0" in got[0].asDict()
    for r in got:
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.pii_spans}
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == [(pii.KINDS[k], a, b) for k, a, b in brute(r.text or "")]
    by = {r.doc_id: r for r in got}
    assert not by[2].pii_spans and not by[0].pii_spans
    assert [s.kind for s in by[40].pii_spans] == ["secret", "secret"]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def em_one_by_one(spans, rounds=50):
    """The same model over single spans, in plain Python: posterior by votes."""
    believed = {}
    for j, name in enumerate(pii.LABELERS):
        for real in (0, 1):
            row = [x + 1e-3 for x in pii.RATES[name][real]]
            believed[j, real] = [x / sum(row) for x in row]
    mass, rates, prior = 10 + len(spans) ** 0.5, dict(believed), 0.5

    def judge(v):
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            a, b = a * rates[j, 1][x + 1], b * rates[j, 0][x + 1]
        return a / (a + b)

    for _ in range(rounds):
        post = [judge(v) for v in spans]
        prior = min(0.99, max(0.01, (sum(post) + 1) / (len(spans) + 2)))
        new = {}
        for j, real in believed:
            row = [x * mass for x in believed[j, real]]
            for v, p in zip(spans, post):
                row[v[j] + 1] += p if real else 1 - p
            new[j, real] = [x / sum(row) for x in row]
        rates = new
    return {v: judge(v) for v in spans}, rates


def drawn(n, seed, share=0.4):
    """Votes of spans of which it is known what they are; the labelers differ from what is believed of them."""
    rng = random.Random(seed)
    true = [[(0.8, 0.0, 0.2), (0.05, 0.0, 0.95)], [(0.0, 0.9, 0.1), (0.0, 0.3, 0.7)], [(0.1, 0.85, 0.05), (0.02, 0.5, 0.48)], [(0.95, 0.0, 0.05), (0.02, 0.0, 0.98)], [(0.5, 0.0, 0.5), (0.1, 0.0, 0.9)]]
    out = []
    for _ in range(n):
        real = int(rng.random() < share)
        out.append((real, tuple(rng.choices((-1, 0, 1), true[j][real])[0] for j in range(5))))
    return true, out


def test_expectation_maximisation_against_plain_python():
    import numpy as np

    _, rows = drawn(400, 5)
    spans = [v for _, v in rows]
    want, rates = em_one_by_one(spans)
    given = sorted(set(spans))
    got = pii.Aggregator(np.array(given), np.array([spans.count(v) for v in given], float))
    for v, p in zip(given, got.posterior):
        assert abs(p - want[v]) < 1e-9
    for j, real in rates:
        assert np.allclose(got.rates[j, real], rates[j, real])


def test_reliabilities_and_rejections_on_labelled_spans():
    import numpy as np

    true, rows = drawn(20_000, 6)
    given = sorted({v for _, v in rows})
    counts = {v: 0 for v in given}
    for _, v in rows:
        counts[v] += 1
    got = pii.Aggregator(np.array(given), np.array([counts[v] for v in given], float))
    posterior = dict(zip(given, got.posterior))
    assert sum((posterior[v] >= 0.5) == real for real, v in rows) / len(rows) > 0.97
    assert abs(got.prior - 0.4) < 0.03
    for j in range(5):  # the beliefs weigh next to nothing by now, so the estimates stand at the truth
        for real in (0, 1):
            assert np.allclose(got.rates[j, real], true[j][real], atol=0.04)


def test_takes_and_rejects_proposals(spark):
    def card(n, ok):
        digits = f"{4000000000000000 + 37 * n}"[:15]
        check = next(c for c in "0123456789" if pii.luhn(digits + c))
        return digits + (check if ok else str((int(check) + 5) % 10))

    real = [f"card {card(i, True)} paid" for i in range(40)] + [f"call (555) 123-45{i:02d} now" for i in range(40)] + [f'token = "{i:02d}6a8c8d79c4a5085c919698889f59b72ab7b0f"' for i in range(40)] + [f"write to ann{i} (at) example (dot) com please" for i in range(40)]
    fake = [f"number {card(i, False)} there" for i in range(40)] + [f"version 3.{i}.2 of it" for i in range(40)] + [f"on 12-05-20{i:02d} and 1-2-3-4 steps" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(real + fake)]
    got = {r.doc_id: r.pii_spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(len(real))) >= 0.9 * len(real)
    assert not any(got[i] for i in range(len(real), len(rows)))
    assert sum(len(list(pii.proposals(t))) for t in fake) >= 80


def test_long_words_take_linear_time():
    import time

    for bit in ("a", "1", "a@", "1.", "+1((", "a:", "1-", "abc123/", "(at)", "@a.b"):
        text, began = bit * (1_000_000 // len(bit)), time.time()
        pii.base_spans(text)
        list(pii.proposals(text))
        assert time.time() - began < 4, bit
    began = time.time()
    text = "x" * 1_000_000
    assert pii.Classifier({}).spans(text, pii.base_spans(text)) == []
    assert time.time() - began < 1


def test_very_long_tokens_and_addresses_are_proposed():
    import time

    key, name = "a1b2C3d4" * 12_500, "x1y" * 40_000
    text = f"token = {key} and {name}@{'host1.' * 20_000}com or {name} (at) {'host1.' * 20_000}org"
    began = time.time()
    found = {(k, text[a:b]) for k, a, b in pii.proposals(text)}
    assert (4, key) in found and (0, f"{name}@{'host1.' * 20_000}com") in found and any(k == 0 and "(at)" in s and len(s) > 200_000 for k, s in found)
    for k, a, b in pii.proposals(text):
        pii.pattern(k, text, a, b)
    assert time.time() - began < 10


def by_hand(texts):
    """The whole operator in plain Python: expectation-maximisation over single spans, a logistic fit by plain Newton steps, overlaps from left to right."""
    spans = [(i, *p) for i, t in enumerate(texts) for p in pii.proposals(t or "")]
    out = [sorted(brute(t or "")) for t in texts]
    for k in range(len(pii.KINDS)):
        mine = [(i, a, b) for i, kind, a, b in spans if kind == k]
        if not mine:
            continue
        votes = [pii.votes(pii.KINDS[k], texts[i], a, b) for i, a, b in mine]
        judged, _ = em_one_by_one(votes)
        y = [judged[v] for v in votes]
        x = []
        for i, a, b in mine:
            row = [1.0]
            for value, width in zip(pii.features(pii.KINDS[k], texts[i], a, b), pii.WIDTHS):
                row += [float(value == w) for w in range(width)]
            x.append(row)
        w = [0.0] * len(x[0])
        for _ in range(400):  # gradient steps on the same loss: logistic, with half the sum of squares
            grad = list(w)
            for row, target in zip(x, y):
                q = 1 / (1 + math.exp(-sum(p * c for p, c in zip(w, row))))
                for n, c in enumerate(row):
                    if c:
                        grad[n] += (q - target) * c
            w = [p - 2.0 / (4 + len(x)) * g for p, g in zip(w, grad)]
        base, reach = list(out), {}
        for (i, a, b), row in zip(mine, x):
            inside = any(kind == k and c < b and a < d for kind, c, d in base[i])
            if not inside and reach.get(i, 0) <= a and sum(p * c for p, c in zip(w, row)) >= 0:
                out[i] = [*out[i], (k, a, b)]
                reach[i] = b
    return [sorted(s) for s in out]


def test_whole_operator_against_plain_python(spark):
    rng = random.Random(8)
    bits = ["call (555) 123-45{0:02d} now", 'token = "{0:02d}6a8c8d79c4a5085c919698889f59b72ab7b0f"', "write to ann{0} (at) example (dot) com", "a.b{0}@mail.org", "version 3.{0}.2 of it", "host 10.0.0.{0}", "card 41111111111111{0:02d}", "on 12-05-20{0:02d}", "plain words here", "+1 555 123 45{0:02d}"]
    texts = [None, ""] + [" and ".join(rng.choice(bits).format(rng.randrange(100)) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    got = {r.doc_id: [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.pii_spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)
    assert sum(len(s) for s in got.values()) > len([1 for t in texts for _ in brute(t or "")])


def test_gazetteers_are_tables_and_reliabilities_are_told(spark):
    own = pii.Gazetteer(endings={"email": {"example"}}, beginnings={"secret": {"corp_"}})
    assert own.knows("email", "a@b.Example") and not own.knows("email", "a@b.com") and own.knows("secret", "corp_12345") and not own.knows("phone", "+1 2")
    for span, known in {"a@b.com": 1, "a@b.COM": 1, "a@bcom": 0, "a (at) b (dot) org": 1, "a at b dot de": 1, "a@b.c": 0}.items():
        assert pii.DEFAULT.knows("email", span) == bool(known), span
    df = spark.createDataFrame([(i, f'token = "{i:02d}6a8c8d79c4a5085c919698889f59b72ab7b0f" or 4111 1111 1111 {i:04d}') for i in range(60)], "doc_id long, text string")
    rows = pii.train(df).reliabilities()
    rates = {(kind, labeler, real, vote): rate for kind, labeler, real, vote, rate in rows}
    assert rates["secret", "context", True, 1] > 0.8 and rates["card", "check", False, -1] > 0.9
    assert all(abs(sum(rates[k, x, real, v] for v in (-1, 0, 1)) - 1) < 1e-9 for k, x, real, _ in rates)
