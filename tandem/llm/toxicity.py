r"""Toxicity by a linear-chain conditional random field.

Words carry one of two tags, other and toxic. Tags to learn from come from the documents' labels: in a document labelled
toxic, a word is toxic if it or one of its beginnings stands in toxic documents far more often than in the rest. The field
weighs words and their beginnings of three to six letters, and tag pairs; it is fitted by gradient ascent on a bounded
sample. Forward-backward gives each word's marginal; their sum, their largest and the chance that none is toxic are
calibrated to a document's score by logistic regression on the same sample, each row weighing as many labelled rows of its
kind as it stands for, so that scores do not follow the sample's own share of toxic rows. Words with a marginal of 0.5 or more,
joined where they touch, are the offending spans, as offsets in code points.

The sample has at most `sample` labelled rows, half of them toxic at most, each text of at most `sample_chars` characters; the
rows with the smallest hash of doc_id are taken. Only rows with crc32(doc_id) mod 4 other than 2 are learned from. Labels,
lang, source and doc_id are no input of a score. Whole texts are scored.

Null and empty texts have no words and the score of a document without any. Null labels are not learned from; without
labels of both kinds, or with no telling word, every score is the share of toxic labels (0 if there are none). Repeated rows
are scored each for itself. Extra columns pass through, renamed if they clash; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, unclash

SAMPLE, SAMPLE_CHARS, THRESHOLD, HELD_OUT = 4000, 20_000, 0.3, 2
STARTS = (3, 4, 5, 6)
CELLS, FLOOR = 1 << 18, 0.02
TOKEN = re.compile(r"[^\W\d_]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def held_out(doc_id: Column, remainder: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == remainder, F.lit(False))


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in STARTS if len(word) >= n]]


def padded(lengths: np.ndarray):
    """Rows in groups of similar length, each of at most CELLS cells unless it is one row."""
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * lengths[order[hi]] <= CELLS:
            hi = min(len(order), hi + max(1, (hi - lo) // 2))
            if (hi - lo) * lengths[order[hi - 1]] > CELLS:
                hi = max(lo + 1, lo + int(CELLS // max(1, lengths[order[hi - 1]])))
                break
        yield order[lo:hi]
        lo = hi


class Field:
    """Two tags; a word's emission is the log-weight of toxic over other. pairs: [[other-other, other-toxic], [toxic-other, toxic-toxic]]."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: np.ndarray, start: float):
        self.weights, self.bias, self.pairs, self.start = weights, bias, pairs, start
        self.known: dict[str, float] = {}

    def emission(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, pair_sums: bool = False):
        """Marginals of toxic, of texts laid one after the other; with pair_sums also the expected counts of tag pairs."""
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        out = np.zeros(len(emissions))
        oo, ot, to, tt = np.exp(self.pairs).ravel()
        sums = np.zeros((2, 2))
        for group in padded(lengths):
            longest = int(lengths[group[-1]])
            if not longest:
                continue
            at = first[group][None, :] + np.arange(longest)[:, None]
            inside = np.arange(longest)[:, None] < lengths[group][None, :]
            e = np.exp(np.clip(emissions[np.minimum(at, len(emissions) - 1)], -30, 30))
            ahead, behind = np.empty_like(e), np.ones_like(e)
            ahead[0] = e[0] * np.exp(self.start)
            for t in range(1, longest):
                ahead[t] = e[t] * (ot + tt * ahead[t - 1]) / (oo + to * ahead[t - 1])
            for t in range(longest - 2, -1, -1):
                g = e[t + 1] * behind[t + 1]
                behind[t] = np.where(inside[t + 1], (to + tt * g) / (oo + ot * g), 1.0)
            odds = ahead * behind
            out[at[inside]] = (odds / (1 + odds))[inside]
            if pair_sums and longest > 1:
                r, g, both = ahead[:-1], e[1:] * behind[1:], inside[1:]
                z = oo + ot * g + to * r + tt * r * g
                for k, v in enumerate((oo / z, ot * g / z, to * r / z, tt * r * g / z)):
                    sums[k // 2, k % 2] += v[both].sum()
        return (out, sums) if pair_sums else out


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, by its marginals: 1, log(1 + sum), largest, log-chance that no word is toxic, share of words. Marginals below FLOOR do not count in sums, or a text would seem toxic for its length alone."""
    out, whole = np.zeros((len(lengths), 5)), p
    p = np.where(p >= FLOOR, p, 0.0)
    out[:, 0] = 1
    some, first = lengths > 0, np.concatenate(([0], np.cumsum(lengths)[:-1]))
    if some.any():
        at = first[some]
        out[some, 1] = np.log1p(np.add.reduceat(p, at))
        out[some, 2] = np.maximum.reduceat(whole, at)
        out[some, 4] = np.log1p(50 * np.add.reduceat(p, at) / lengths[some])
        out[some, 3] = -np.maximum(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), at), -5)
    return out


def logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (mass * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (mass * (y - q)) - ridge * w), -2, 2)
    return w


class Model:
    def __init__(self, field: Field | None, weights: np.ndarray, share: float):
        self.field, self.weights, self.share = field, weights, share

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        if self.field is None:
            return np.full(len(texts), self.share), [[] for _ in texts]
        low = [lowered(t) for t in texts]
        words = [TOKEN.findall(t) for t in low]
        lengths = np.array([len(w) for w in words], np.int64)
        emission = self.field.emission
        p = self.field.marginals(np.fromiter((emission(w) for ws in words for w in ws), float, int(lengths.sum())), lengths)
        scores = 1 / (1 + np.exp(-summary(p, lengths) @ self.weights))
        spans, ends = [[] for _ in texts], np.cumsum(lengths)
        hot = np.flatnonzero(p >= 0.5)
        for row in np.unique(np.searchsorted(ends, hot, "right")):
            at, begin = [m.span() for m in TOKEN.finditer(low[row])], ends[row] - lengths[row]
            for i in hot[(hot >= begin) & (hot < ends[row])] - begin:
                (a, b), q = at[i], float(p[begin + i])
                last = spans[row][-1] if spans[row] else None
                if last and last[3] == i - 1:
                    spans[row][-1] = (last[0], b, max(last[2], q), i)
                else:
                    spans[row].append((a, b, q, i))
        return scores, [[s[:3] for s in x] for x in spans]


def fit(texts: list[str], toxic: list[int], mass: list[tuple[float, float]] | None = None, steps: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """The field and its calibration from whole texts, their labels and the clean and toxic rows each stands for (one of its label without mass)."""
    y = np.array(toxic, float)
    rows_of = np.stack([1 - y, y], 1) if mass is None else np.array(mass, float).reshape(-1, 2)
    share = float(rows_of[:, 1].sum() / rows_of.sum()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return Model(None, np.zeros(5), share)
    # words and features are numbers from here on: a text is an array, and a word is a row of features
    vocabulary: dict[str, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in TOKEN.findall(lowered(t))), np.int32) for t in texts]
    known: dict[str, int] = {}
    n_features, flat = [], []
    for w in vocabulary:
        fs = features(w)
        n_features.append(len(fs))
        flat.extend(known.setdefault(f, len(known)) for f in fs)
    flat, ends, n_rows = np.array(flat, np.int32), np.concatenate(([0], np.cumsum(n_features))).astype(np.int64), len(vocabulary)
    del vocabulary
    owner = np.repeat(np.arange(n_rows, dtype=np.int32), n_features)
    counts, often, total = np.zeros((2, len(known)), np.int64), np.zeros((2, len(known))), [1, 1]  # documents and words with a feature, words
    for doc, label in zip(docs, toxic):
        mine, n = np.unique(doc, return_counts=True)
        here = np.concatenate([np.zeros(0, np.int32), *[flat[ends[w] : ends[w + 1]] for w in mine.tolist()]])
        counts[label, np.unique(here)] += 1
        np.add.at(often[label], here, np.repeat(n, ends[mine + 1] - ends[mine]) if len(mine) else 0)
        total[label] += len(doc)
    telling = (counts[1] >= max(3, 0.01 * y.sum())) & (often[1] / total[1] >= 10 * (often[0] + 1) / total[0])
    if not telling.any():
        return Model(None, np.zeros(5), share)
    chosen = telling | (counts.sum(0) >= max(3, 0.003 * len(y)))
    kept, renumbered = [f for f, c in zip(known, chosen.tolist()) if c], np.cumsum(chosen) - 1
    del known, counts, often
    hot = np.bincount(owner, telling[flat], n_rows) > 0
    some = chosen[flat]
    owner, feature = owner[some], renumbered[flat[some]].astype(np.int32)
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *docs])
    del docs, flat
    rows = range(n_rows)
    tags = hot[ids] & np.repeat(y > 0, lengths)
    weights, bias, pairs, start = np.zeros(len(kept)), -3.0, np.zeros((2, 2)), 0.0
    real_words = np.bincount(ids, tags, len(rows))
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    a, b = tags[:-1][inner[:-1]].astype(int), tags[1:][inner[:-1]].astype(int)
    real_pairs = np.bincount(2 * a + b, minlength=4).reshape(2, 2)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]
    speed = [np.full(len(kept), 1e-6), 1e-6, np.full((2, 2), 1e-6), 1e-6]
    for _ in range(steps):
        emission = bias + np.bincount(owner, weights[feature], len(rows))
        field = Field({}, bias, pairs, start)
        p, sums = field.marginals(emission[ids], lengths, pair_sums=True)
        gap = real_words - np.bincount(ids, p, len(rows))
        slopes = [np.bincount(feature, gap[owner], len(kept)) - ridge * len(ids) * 1e-3 * weights, gap.sum(), real_pairs - sums, (tags[first] - p[first]).sum()]
        for k, g in enumerate(slopes):  # Adagrad: weights of rare features move as fast as those of frequent ones
            speed[k] = speed[k] + g * g
        weights = weights + rate * slopes[0] / np.sqrt(speed[0])
        bias += rate * slopes[1] / np.sqrt(speed[1])
        pairs = pairs + 0.5 * rate * slopes[2] / np.sqrt(speed[2])
        start += rate * slopes[3] / np.sqrt(speed[3])
    field = Field({f: float(weights[i]) for i, f in enumerate(kept) if abs(weights[i]) > 1e-3}, float(bias), pairs, float(start))
    p = field.marginals((bias + np.bincount(owner, weights[feature], len(rows)))[ids], lengths)
    return Model(field, logistic(summary(p, lengths), rows_of[:, 1] / rows_of.sum(1), rows_of.sum(1)), share)


def weighted_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int], list[tuple[float, float]]]:
    """Texts, their labels and how many clean and toxic rows of all that may be learned from each text stands for, copies counted."""
    known = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    order = [F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")]
    most = {1: sample // 2, 0: sample - sample // 2}
    stands_for = {r._toxic: max(1.0, r["count"] / max(1, most[r._toxic])) for r in known.groupBy("_toxic").count().collect()}
    picked = known.where("_toxic = 1").orderBy(*order).limit(most[1]).unionAll(known.where("_toxic = 0").orderBy(*order).limit(most[0]))
    rows = documents.where(F.length("text").between(1, sample_chars)).join(F.broadcast(picked.withColumnRenamed("doc_id", "_doc_id")), F.col("doc_id") == F.col("_doc_id"))
    rows = rows.groupBy("_doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))  # one row for a repeated document
    found = sorted(((r._doc_id, r.text, int(r.toxic)) for r in rows.collect()), key=lambda r: r[0])
    seen = {t: y for _, t, y in found}  # copies would teach the same words again
    mass = {t: [0.0, 0.0] for t in seen}
    for _, t, y in found:
        mass[t][y] += stands_for[y]
    return list(seen), list(seen.values()), [tuple(m) for m in mass.values()]


def training_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """The texts and labels of weighted_sample alone: enough for fit only while there are no copies and no limit binds."""
    return weighted_sample(documents, labels, sample, sample_chars)[:2]


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents with score, predicted and toxic_spans."""
    documents = unclash(documents, {"score", "predicted", "toxic_spans"})
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", SPANS)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            scores, spans = [], []
            for lo in range(0, len(column), 250):
                s, x = shared.value.score([t or "" for t in column[lo : lo + 250].to_pylist()])
                scores.append(s)
                spans += [[{"start": a, "end": b, "p": q} for a, b, q in row] for row in x]
            added = [pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return documents.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity_crf(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*weighted_sample(documents, read(spark, sf_dir, "labels")))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
