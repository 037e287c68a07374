import math
import itertools
import random
import zlib

import numpy as np

from tandem.llm import toxicity


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("bcdfgaeiou", k=rng.randint(2, 8))) for _ in range(900)]
    bad = [f"zorg{x}" for x in ("", "ed", "ing", "ly", "est")] + ["vilkan", "Trask"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = rng.choices(plain, k=rng.randint(20, 200))
        for _ in range(rng.randint(4, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_spans(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "zorged zorgly zorg vilkan trask and then"), (1, rows[1][1])], "doc_id long, text string").withColumn("score", toxicity.F.lit("old"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9003, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 100 and sum(r.predicted == y for r, y in out) / len(out) > 0.97
    assert 0 <= got[9000].score < 0.3 and got[9001].score == got[9000].score and got[9002].predicted == 1
    spans = got[9002].toxic_spans
    assert spans and "zorg" in got[9002].text[spans[0].start : spans[0].end]
    assert got[1].score_0 == "old"


def test_learns_nothing_from_held_out_rows(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    texts, _ = toxicity.training_sample(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert set(texts) <= {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}


def test_without_labels_every_score_is_the_share(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(*toxicity.training_sample(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_scores_do_not_follow_the_sample_share(spark):
    rng, rows = random.Random(6), []
    for i, text, _ in corpus(1500, 6):  # telling words also stand in some clean documents, so that the prior matters
        kind = rng.random()
        hot, toxic = (rng.randint(1, 4), 1) if kind < 0.1 else (rng.randint(1, 2), 0) if kind < 0.17 else (0, 0)
        words = [w for w in text.split() if not w.lower().startswith(("zorg", "vilkan", "trask"))]
        for _ in range(hot):
            words.insert(rng.randrange(len(words)), rng.choice(["zorg", "zorged", "vilkan"]))
        rows.append((i, " ".join(words), toxic))
    rows += [(2000 + k, rows[0][1], 0) for k in range(60)]  # copies count as rows, however many of them are sampled
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, bounded = (toxicity.weighted_sample(docs, labels, sample=n) for n in (4000, 150))
    assert len(bounded[0]) <= 150 < len(whole[0])
    allowed = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    for _, _, mass in (whole, bounded):
        assert abs(sum(m[0] for m in mass) - allowed.count(0)) < 1e-6 and abs(sum(m[1] for m in mass) - allowed.count(1)) < 1e-6
    texts = [t for _, t, _ in rows]
    a, b, unweighted = (toxicity.fit(*x).score(texts)[0] for x in (whole, bounded, bounded[:2]))
    assert abs(a.mean() - sum(allowed) / len(allowed)) < 0.03 and abs(a.mean() - b.mean()) < 0.03 and np.abs(a - b).mean() < 0.05
    assert abs(a.mean() - unweighted.mean()) > 0.05  # what the bounded sample's own share would give
    assert toxicity.fit(["a b"] * 4, [0, 0, 1, 1], [(9.0, 0.0)] * 2 + [(0.0, 1.0)] * 2).share == 0.1


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(0)
    f = toxicity.Field({}, 0.0, rng.normal(size=(2, 2)), 0.3)
    e = rng.normal(size=9)
    got = f.marginals(e, np.array([4, 0, 5]))
    for lo, hi in ((0, 4), (4, 9)):
        total, hot = 0.0, np.zeros(hi - lo)
        for code in range(1 << (hi - lo)):
            tags = [(code >> k) & 1 for k in range(hi - lo)]
            w = np.exp(sum(e[lo + k] for k, t in enumerate(tags) if t) + 0.3 * tags[0] + sum(f.pairs[a, b] for a, b in zip(tags, tags[1:])))
            total, hot = total + w, hot + w * np.array(tags)
        assert np.allclose(got[lo:hi], hot / total)


def tiny():
    rng = random.Random(8)
    clean = [" ".join(rng.choice(["sun", "rain", "wind", "tree", "leaf"]) for _ in range(rng.randint(3, 7))) for _ in range(40)]
    toxic = [" ".join(rng.choice(["sun", "rain", "vilest", "vileness", "tree"]) for _ in range(rng.randint(3, 7))) + " vilest" for _ in range(30)]
    return clean + toxic, [0] * 40 + [1] * 30


def taggings(field, words):
    """(tags, weight) of every tagging, by the field's own weights."""
    emissions = [field.bias + sum(field.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words]
    for tags in itertools.product((0, 1), repeat=len(words)):
        score = field.start * tags[0] + sum(e for e, t in zip(emissions, tags) if t) + sum(field.pairs[a][b] for a, b in zip(tags, tags[1:]))
        yield tags, math.exp(score)


def test_scores_and_spans_against_all_taggings():
    texts, labels = tiny()
    model = toxicity.fit(texts, labels)
    some = ["Vilest wind, vilest  VILENESS tree", "sun rain", "tree vilest", "vilest"]
    scores, spans = model.score([*some, ""])
    for text, got, found in zip(some, scores, spans):
        words = toxicity.TOKEN.findall(text.lower())
        every = list(taggings(model.field, words))
        whole = sum(w for _, w in every)
        p = [sum(w for t, w in every if t[i]) / whole for i in range(len(words))]
        q = [x if x >= toxicity.FLOOR else 0.0 for x in p]
        parts = [1, math.log1p(sum(q)), max(p), min(5, -sum(math.log1p(-min(x, 1 - 1e-9)) for x in q)), math.log1p(50 * sum(q) / len(q))]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(parts, model.weights))))
        assert abs(got - want) < 1e-9
        places = [m.span() for m in toxicity.TOKEN.finditer(text.lower())]
        covered = {i for i, (a, b) in enumerate(places) if any(x <= a and b <= y for x, y, _ in found)}
        assert covered == {i for i, x in enumerate(p) if x >= 0.5}
    assert spans[0] and not spans[1] and spans[0][-1][:2] == (13, 29)


def test_fit_raises_the_likelihood_of_the_tags():
    texts, labels = tiny()

    def likelihood(model):
        total = 0.0
        for text, label in zip(texts, labels):
            words = text.split()
            tags = tuple(int(label and w.startswith("vile")) for w in words)
            every = dict(taggings(model.field, words))
            total += math.log(every[tags] / sum(every.values()))
        return total

    values = [likelihood(toxicity.fit(texts, labels, steps=n)) for n in (1, 5, 30, 120)]
    assert values == sorted(values) and values[-1] > -5


def test_calibration_is_at_its_maximum():
    import numpy as np

    rng = np.random.default_rng(2)
    x, y, mass = np.column_stack([np.ones(60), rng.normal(size=(60, 2))]), rng.random(60), rng.random(60) * 9
    w = toxicity.logistic(x, y, mass)
    assert np.abs(x.T @ (mass * (y - 1 / (1 + np.exp(-x @ w)))) - 1e-2 * w).max() < 1e-6


def test_one_very_long_text(spark):
    texts, labels = tiny()
    model = toxicity.fit(texts, labels)
    rows = [(1, "sun " * 250_000), (2, "x" * 1_000_000), (3, "sun " * 1000 + "vilest " * 3), (4, None), (5, ""), (5, "")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[3].predicted == 1 and got[3].toxic_spans[0].start == 4000 and got[1].predicted == got[2].predicted == got[4].predicted == got[5].predicted == 0
