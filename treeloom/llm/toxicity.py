"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of the embeddings of its hash and of the hashes
of its first four and six bytes, so that inflected forms share what they have
learned; features in fewer than ``MIN_DF`` texts of the sample have none, which
keeps the maxima from resting on words that occur once.  Filters of several
widths run over the whole text, each keeps its maximum, and a logistic layer
gives the score.  Training
is plain numpy with Adagrad steps (the gradient of a maximum touches one place
a filter, so a step is cheap) on a bounded sample of labelled rows.  A filter
over embeddings is a sum of one table look-up a word and offset, so scoring
needs no matrix product.

Thresholds are calibrated by language: what a text's language is, its own
commonest function words say, never a column.  On held-back training rows a
shift of each language's logit puts the best cut at ``CUT``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm._bytes import ALNUM, Words, hash_words, mix, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUT = 0.3
PREFIXES = (4, 6)
MIN_DF = 4
SAMPLE = 8_000  # labelled rows to fit on
SAMPLE_DOC_WORDS = 2_000  # longer texts are not fitted on (all are scored)
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 12
EPOCHS, SEED = 8, 7
PRIOR = 20  # positives that the cut of all languages counts for in each

#: Function words by language, to tell a text's language from itself.
FUNCTION_WORDS = {
    "en": "the and of to in that is was for with are this not have from",
    "de": "der die und das nicht mit von den ist ein eine auf sich auch des",
    "fr": "le la les et des une est que pas pour dans sur par avec du",
    "es": "el los las una del que con por para se su al es un y",
}
LANGS = (*FUNCTION_WORDS, "other")


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    pairs: dict[str, set[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            pairs.setdefault(w, set()).add(k)
    own = [(w, next(iter(k))) for w, k in pairs.items() if len(k) == 1]
    h = hash_words([w for w, _ in own])
    order = np.argsort(h)
    return h[order], np.array([k for _, k in own])[order]


class Texts:
    """Feature hashes (one row a kind, 32 bits each; 0: none) of the words of
    a run of texts, and the texts' language numbers."""

    def __init__(self, buf, offsets, table):
        words = Words(buf, offsets, ALNUM, True)
        h, size = words.hashes(), words.end - words.start
        self.first, self.count, self.docs = words.first, words.count, words.docs
        kinds = [h]
        for k, n in enumerate(PREFIXES):
            kinds.append(np.where(size > n, mix(words.prefix_hashes(n) + np.uint64(k + 1)), np.uint64(0)))
        self.hashes = np.stack([(x >> np.uint64(32)).astype(np.uint32) for x in kinds])
        keys, lang = table
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h)
        votes = np.zeros((self.docs, len(LANGS)), np.int64)
        doc = np.searchsorted(words.first, hit, "right") - 1
        np.add.at(votes, (doc, lang[at[hit]]), 1)
        self.lang = np.where(votes.max(1) > 0, votes.argmax(1), len(LANGS) - 1)


class Model:
    """``keys``: sorted hashes of the known features; feature number 0 is no
    feature, number i + 1 is ``keys[i]``."""

    def __init__(self, keys: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.keys = keys
        self.embed = rng.normal(0, 0.2, (len(keys) + 1, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-2.0)
        self.shift = np.zeros(len(LANGS))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes) & (hashes != 0), at + 1, 0).astype(np.int32)

    def freeze(self) -> None:
        """Look-up tables: what a feature adds to a filter at each offset."""
        self.tables = {w: [np.ascontiguousarray(self.embed @ self.filters[w][j]) for j in range(w)] for w in WIDTHS}

    def pooled(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter maxima of each text; a text shorter than a filter has 0."""
        docs, count, total = len(first) - 1, np.diff(first), numbers.shape[1]
        out = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            if total < w:
                continue
            n = total - w + 1
            act = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                for kind in numbers:
                    act += self.tables[w][j][kind[j : n + j]]
            for d in np.flatnonzero(count >= w):
                a = first[d]
                out[d, k * FILTERS : (k + 1) * FILTERS] = act[a : a + count[d] - w + 1].max(0)
            out[:, k * FILTERS : (k + 1) * FILTERS] += self.bias[w]
        return np.maximum(out, 0)

    def logits(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(numbers, first) @ self.out + self.base

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng, rate = np.random.default_rng(seed), 0.1
        grads = {"embed": np.full(self.embed.shape, 1e-2, np.float32), "out": np.full(self.out.shape, 1e-2, np.float32)}
        squares = {w: np.full(self.filters[w].shape, 1e-2, np.float32) for w in WIDTHS}
        bias_sq = {w: np.full(FILTERS, 1e-2, np.float32) for w in WIDTHS}
        base_sq, weight = 1e-2, np.where(labels == 1, min(4.0, max(1.0, (labels == 0).sum() / max(1, (labels == 1).sum()) / 2)), 1.0)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lot in np.array_split(order, max(1, len(order) // 16)):
                places, feats = [], np.zeros((len(lot), len(self.out)), np.float32)
                for r, i in enumerate(lot):
                    x = texts[i]
                    e = self.embed[x].sum(0)
                    for k, w in enumerate(WIDTHS):
                        if len(e) < w:
                            continue
                        n = len(e) - w + 1
                        act = e[:n] @ self.filters[w][0]
                        for j in range(1, w):
                            act += e[j : n + j] @ self.filters[w][j]
                        top = act.argmax(0)
                        feats[r, k * FILTERS : (k + 1) * FILTERS] = np.maximum(act[top, np.arange(FILTERS)] + self.bias[w], 0)
                        places.append((r, k, w, x, top))
                p = 1 / (1 + np.exp(-(feats @ self.out + self.base)))
                err = ((p - labels[lot]) * weight[lot]).astype(np.float32)
                back = err[:, None] * self.out[None, :] * (feats > 0)
                g = feats.T @ err
                grads["out"] += g * g
                self.out -= rate * g / np.sqrt(grads["out"])
                base_sq += float(err.sum()) ** 2
                self.base -= np.float32(rate * err.sum() / math.sqrt(base_sq))
                f_grad = {w: np.zeros_like(self.filters[w]) for w in WIDTHS}
                b_grad = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
                ids, steps = [], []
                for r, k, w, x, top in places:
                    d = back[r, k * FILTERS : (k + 1) * FILTERS]
                    on = np.flatnonzero(d)
                    if not len(on):
                        continue
                    b_grad[w] += d
                    for j in range(w):
                        word = x[:, top[on] + j]
                        f_grad[w][j][:, on] += self.embed[word].sum(0).T * d[on]
                        step = self.filters[w][j][:, on].T * d[on][:, None]
                        for kind in word:
                            ids.append(kind)
                            steps.append(step)
                for w in WIDTHS:
                    squares[w] += f_grad[w] ** 2
                    self.filters[w] -= rate * f_grad[w] / np.sqrt(squares[w])
                    bias_sq[w] += b_grad[w] ** 2
                    self.bias[w] -= rate * b_grad[w] / np.sqrt(bias_sq[w])
                if ids:
                    rows, inverse = np.unique(np.concatenate(ids), return_inverse=True)
                    total = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(total, inverse, np.concatenate(steps))
                    grads["embed"][rows] += total**2
                    self.embed[rows] -= rate * total / np.sqrt(grads["embed"][rows])
                    self.embed[0] = 0
        self.freeze()

    def calibrate(self, logits: np.ndarray, langs: np.ndarray, labels: np.ndarray) -> None:
        """Shifts each language's logits so that the cut of best F1 scores
        ``CUT``, be it above or below that of all rows.  A language's own cut
        is drawn to the common one as if that had ``PRIOR`` positives; cuts
        lie midway between neighbouring logits."""

        def best(x, y):
            order = np.argsort(-x, kind="stable")
            x, y = x[order], y[order]
            f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
            k = int(f1.argmax())
            return float((x[k] + x[min(k + 1, len(x) - 1)]) / 2)

        want = math.log(CUT / (1 - CUT))
        common = best(logits, labels) if labels.sum() else float(logits.max(initial=0.0))
        for k in range(len(LANGS)):
            own = langs == k
            weight = labels[own].sum() / (labels[own].sum() + PRIOR)
            cut = weight * best(logits[own], labels[own]) + (1 - weight) * common if weight else common
            self.shift[k] = want - cut


def score_texts(model: Model, column, table) -> np.ndarray:
    out = []
    for _, buf, offsets in text_slices(column, 1 << 18):
        texts = Texts(buf, offsets, table)
        x = model.logits(model.numbers(texts.hashes), texts.first) + model.shift[texts.lang]
        out.append(1 / (1 + np.exp(-np.clip(x, -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _pack(table):
    def run(batches):
        for batch in batches:
            ids, words, langs = [], [], []
            for _, buf, offsets in text_slices(batch.column(1)):
                texts = Texts(buf, offsets, table)
                for d in range(texts.docs):
                    words.append(texts.hashes[:, texts.first[d] : texts.first[d + 1]].tobytes())
                langs.append(texts.lang)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(words, pa.binary()), pa.array(np.concatenate(langs).astype(np.int32) if langs else [], pa.int32())], ["doc_id", "toxic", "words", "lang"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows of at most ``SAMPLE_DOC_WORDS``
    words, half of them positives if there are enough, both in the order of a
    hash of the id.  Rows of an id whose labels differ, null labels and held-out rows
    are not used.  Without rows of both labels the model stays a constant."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = chosen.where("toxic = 1").orderBy(order, "doc_id").limit(sample // 2).unionAll(chosen.where("toxic = 0").orderBy(order, "doc_id").limit(sample // 2))
    table = _word_table()
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_pack(table), "doc_id bigint, toxic int, words binary, lang int")
    hashes, y, langs, kinds = [], [], [], 1 + len(PREFIXES)
    got = rows.where(F.length("words") <= 4 * kinds * SAMPLE_DOC_WORDS).collect()  # bounded by the two parameters
    for r in sorted(got, key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) & (2**64 - 1), bytes(r["words"]))):
        if r["words"]:
            hashes.append(np.frombuffer(r["words"], np.uint32).reshape(kinds, -1))
            y.append(r["toxic"])
            langs.append(r["lang"])
    y, langs = np.array(y, np.int64), np.array(langs, np.int64)
    if len(set(y.tolist())) < 2:
        model = Model(np.zeros(0, np.uint32))
        model.out[:] = 0
        model.base = np.float32(10.0 if len(y) and y[0] else -10.0)
        model.freeze()
        return model
    back = np.arange(len(y)) % 4 == 3  # held back to calibrate on
    seen, df = np.unique(np.concatenate([np.unique(h) for h, b in zip(hashes, back, strict=True) if not b]), return_counts=True)
    model = Model(seen[(df >= MIN_DF) & (seen != 0)])
    texts = [model.numbers(h) for h in hashes]
    model.fit([t for t, b in zip(texts, back, strict=True) if not b], y[~back])
    logits = np.concatenate([model.logits(t, np.array([0, t.shape[1]])) for t in texts])
    model.calibrate(logits[back], langs[back], y[back])
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``.
    A null or empty text has no filter maxima, and so the score of the bias
    alone.  A null id is not held out.  Repeated rows are scored each; columns
    besides ``doc_id`` and ``text`` are not read."""
    model, table = train(docs, labels, sample), _word_table()
    model.embed = np.zeros((0, DIM), np.float32)  # the tables are enough

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model, batch.column(1), table))], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Keeps the rows that score below ``CUT``; all columns stay."""
    model, table = train(docs, labels), _word_table()
    model.embed = np.zeros((0, DIM), np.float32)
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, batch.column(text_at), table) < CUT))

    return docs.mapInArrow(run, docs.schema)
