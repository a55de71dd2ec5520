"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (3 to 6, with border marks), hashed to
BUCKETS vectors; its vector is their mean, a passage's vector the mean of its
words, and a linear softmax on top gives the classes. Embeddings and softmax are
trained together in numpy by minibatch gradients with Adagrad, each update on a
random half of every word's n-grams. Misspellings that were never seen share most
n-grams with words that were.

A document is cut into passages of about PASSAGE words and scored by its most
toxic one, so a long text does not dilute a toxic passage. Only documents are
labelled, so training goes in rounds, from a random start: the first takes every
passage with its document's label, which clean passages of toxic documents share
with clean documents and toxic ones don't; in the next two, of every document
the passages that the model so far puts highest (and random ones of clean
documents) train it on. A logistic curve fitted on training documents that the
model did not see maps the largest passage logit to the score.

The training sample is bounded: at most PER_CLASS labelled documents per class,
first by hash of doc_id, of those for which crc32(doc_id) mod 5 is not 0.
Everything else covers all rows. Once trained, n-gram scores are one table, and
scoring is vectorised over the bytes of whole texts.

Defined cases: null and empty texts and others without words score 0; labels
that are null are ignored, of contradicting ones the larger counts; without both
classes the score is the share of toxic labels (0 without labels); repeated rows
get equal scores; other columns are carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices

BUCKETS, DIM, SIZES = 1 << 18, 4, (3, 4, 5, 6)
PASSAGE, PER_CLASS, EPOCHS, BATCH = 8, 2000, 3, 1024
PICKED = 0.1
KEPT = 0.5  # share of a word's n-grams that an update sees, so that all of them learn what some would tell: a misspelling lacks some
FLOOR = 1e-16  # of Adagrad's sums; a passage's gradient is spread over its n-grams, squares of some 1e-13 must not drown in it
ROUNDS, UPDATES = 3, 64  # updates of a round at least, however few passages there are
CHUNK = 1 << 19
WORD_BYTE = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def words_and_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin of each word, and word number and bucket of each n-gram, of lower-cased UTF-8."""
    a = np.frombuffer(b" " + data + b" ", np.uint8)
    inside = WORD_BYTE[a]
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    b = np.where(inside, a, 32).astype(np.uint32)
    number = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]), dtype=np.int32) - 1
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    n_all = len(a)
    h, words, grams = b.copy(), [], []
    for n in range(2, SIZES[-1] + 1):
        if n > n_all:
            break
        h = h[: n_all - n + 1] * np.uint32(16777619) + b[n - 1 :]
        if n < SIZES[0]:
            continue
        # no gap strictly inside; the first inner byte then belongs to the gram's word
        at = np.flatnonzero(gaps[n - 1 : n_all] == gaps[1 : n_all - n + 2])
        x = h[at] * np.uint32(2654435761) + np.uint32(n * 40503)
        grams.append(((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32))
        words.append(number[at + 1])
    if not grams or not len(begin):
        return begin, np.empty(0, np.int32), np.empty(0, np.int32)
    return begin, np.concatenate(words), np.concatenate(grams)


def passage_starts(n: int) -> np.ndarray:
    """Word numbers at which about equal passages of PASSAGE words begin."""
    k = max(1, round(n / PASSAGE))
    return np.arange(k) * n // k


class Model:
    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift

    def word_scores(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        begin, words, grams = words_and_grams(data)
        total = np.bincount(words, self.table[grams], len(begin))
        return begin, total / np.maximum(np.bincount(words, minlength=len(begin)), 1)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Largest passage logit of each text; minus infinity without words."""
        out, at = np.full(len(texts), -np.inf), 0
        while at < len(texts):
            parts, size, first = [], 0, at
            while at < len(texts) and (size < CHUNK or first == at):
                parts.append(texts[at].lower().encode("utf-8", "replace"))
                size += len(parts[-1]) + 1
                at += 1
            begin, score = self.word_scores(b" ".join(parts))
            ends = np.cumsum([len(p) + 1 for p in parts]) + 1  # a text's bytes begin at 1 in the padded data
            cut = np.concatenate([[0], np.searchsorted(begin, ends)])
            for k in range(len(parts)):
                s = score[cut[k] : cut[k + 1]]
                if len(s):
                    starts = passage_starts(len(s))
                    sums = np.add.reduceat(s, starts)
                    out[first + k] = self.bias + (sums / np.diff(np.append(starts, len(s)))).max()
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.logits(texts) - self.shift), -30, 30)))


class _Sample:
    """Passages of texts as rows of distinct-word numbers, and n-grams by distinct word."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[bytes, int] = {}
        tokens, starts, owner = [], [], []
        total = 0
        clean = bytes(b if WORD_BYTE[b] else 32 for b in range(256))
        for k, text in enumerate(texts):
            found = text.lower().encode("utf-8", "replace").translate(clean).split()
            ids = [known.setdefault(w, len(known)) for w in found]
            if ids:
                cut = passage_starts(len(ids))
                starts.append(cut + total)
                owner.append(np.full(len(cut), k))
                tokens.append(np.array(ids))
                total += len(ids)
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        self.starts = np.append(np.concatenate(starts) if starts else [], total).astype(np.int64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        names, parts, sizes = list(known), [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for at in range(0, len(names), 1 << 15):
            some = names[at : at + (1 << 15)]
            _, words, grams = words_and_grams(b" ".join(some))
            parts.append(grams[np.argsort(words, kind="stable")])
            sizes.append(np.bincount(words, minlength=len(some)))
        self.grams, self.first = np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+size[0]-1, begin[1] .., all in one array."""
    out = np.ones(int(size.sum()), np.int64)
    if len(out):
        ends = np.cumsum(size)[:-1]
        out[0] = begin[0]
        out[ends] = begin[1:] - begin[:-1] - size[:-1] + 1
    return np.cumsum(out)


class _Layers:
    """Embeddings and softmax, from a random start."""

    def __init__(self, rng) -> None:
        self.emb = (rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32)
        self.soft = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def table(self) -> np.ndarray:
        return (self.emb @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32)


def _passages(sample: _Sample, docs: np.ndarray, n: int) -> np.ndarray:
    """All passages of the given of n documents."""
    use = np.zeros(n, bool)
    use[docs] = True
    return np.flatnonzero(use[sample.owner])


def _pick(sample: _Sample, table: np.ndarray, docs: np.ndarray, y: np.ndarray, rng) -> np.ndarray:
    """Passages to train on: of each document its highest tenth, at least one; of clean ones a random tenth too."""
    first = sample.first[:-1]
    word = np.add.reduceat(table[sample.grams], first) / np.diff(sample.first)
    score = np.add.reduceat(word[sample.tokens], sample.starts[:-1]) / np.diff(sample.starts)
    order = np.lexsort((-score, sample.owner))
    size = np.bincount(sample.owner, minlength=len(y))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    top = np.zeros(len(order), bool)
    top[order] = rank < np.maximum(1, PICKED * size[sample.owner[order]])
    top |= (y[sample.owner] == 0) & (rng.random(len(order)) < PICKED)
    every = _passages(sample, docs, len(y))
    return every[top[every]]


def _fit(layers: _Layers, sample: _Sample, rows: np.ndarray, labels: np.ndarray, epochs: int, rng) -> None:
    """Trains embeddings and softmax together on passages."""
    emb, soft, bias = layers.emb, layers.soft, layers.bias
    seen_e, seen_s, seen_b = np.full(BUCKETS, FLOOR, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = (0.5 / np.maximum(share, 1e-9))[labels].astype(np.float32)
    batches = max(min(8, len(rows)), len(rows) // BATCH)
    for _ in range(max(epochs, -(-UPDATES // batches))):
        for part in np.array_split(rng.permutation(len(rows)), batches):
            p = rows[part]
            n_words = sample.starts[p + 1] - sample.starts[p]
            used, word = np.unique(sample.tokens[_ranges(sample.starts[p], n_words)], return_inverse=True)
            n_grams = sample.first[used + 1] - sample.first[used]
            grams = sample.grams[_ranges(sample.first[used], n_grams)]
            of_word = np.repeat(np.arange(len(used)), n_grams)
            edge = np.concatenate([[0], np.cumsum(n_grams)[:-1]])
            here = (rng.random(len(grams)) < KEPT).astype(np.float32) / KEPT
            vectors = np.add.reduceat(emb[grams] * here[:, None], edge, axis=0) / n_grams[:, None]
            edge = np.concatenate([[0], np.cumsum(n_words)[:-1]])
            mean = np.add.reduceat(vectors[word], edge, axis=0) / n_words[:, None]
            z = mean @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob
            d[np.arange(len(p)), labels[part]] -= 1
            d *= weight[part][:, None] / len(p)
            g_soft, g_bias, g_mean = mean.T @ d, d.sum(axis=0), (d @ soft.T) / n_words[:, None]
            of_passage = np.repeat(np.arange(len(p)), n_words)
            g_word = np.stack([np.bincount(word, g_mean[of_passage, k], len(used)) for k in range(DIM)], axis=1) / n_grams[:, None]
            some, where = np.unique(grams, return_inverse=True)
            g_emb = np.stack([np.bincount(where, g_word[of_word, k] * here, len(some)) for k in range(DIM)], axis=1).astype(np.float32)
            seen_e[some] += (g_emb**2).mean(axis=1)
            emb[some] -= 0.1 * g_emb / np.sqrt(seen_e[some])[:, None]
            seen_s += g_soft**2
            soft -= (0.03 * g_soft / np.sqrt(seen_s)).astype(np.float32)
            seen_b += g_bias**2
            bias -= (0.1 * g_bias / np.sqrt(seen_b)).astype(np.float32)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve; the shift separates the classes best.

    Where there is a gap between them it lies a third above the clean side, as
    unseen forms of toxic words score below seen ones.
    """
    order = np.argsort(x)
    x, y = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    best = best[len(best) // 2]
    low, high = x[max(0, best - 1)], x[min(len(x) - 1, best)]
    shift = float(low + (high - low) / 3)
    gap = float(np.abs(x - shift).mean()) or 1.0
    return 3.0 / gap, shift


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    y = np.array(labels, np.int64)
    empty = np.zeros(BUCKETS, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    fallback = Model(empty, 0.0, 1.0, -float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if len(set(labels)) < 2:
        return fallback
    rng = np.random.default_rng(seed)
    sample = _Sample(texts)
    aside = rng.random(len(texts)) < 0.2
    for cls in (0, 1):
        if aside[y == cls].all():
            aside[np.flatnonzero(y == cls)[0]] = False
    docs = np.flatnonzero(~aside & np.isin(np.arange(len(y)), sample.owner))
    if len(set(y[docs].tolist())) < 2:
        return fallback
    layers = _Layers(rng)
    for k in range(ROUNDS):
        rows = _pick(sample, layers.table(), docs, y, rng) if k else _passages(sample, docs, len(y))
        _fit(layers, sample, rows, y[sample.owner[rows]], EPOCHS, rng)
    table, bias = layers.table(), float(layers.bias[1] - layers.bias[0])
    raw = Model(table, bias, 1.0, 0.0)
    check = np.flatnonzero(aside)
    if len(set(y[check].tolist())) < 2:
        check = np.arange(len(texts))
    x = raw.logits([texts[k] for k in check])
    slope, shift = _curve(x[np.isfinite(x)], y[check][np.isfinite(x)])
    return Model(table, bias, slope, shift)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Collects at most 2 * per_class texts."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    chosen = [marked.where(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    few = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * per_class rows
    # of rows that share a labelled id the least text, so that a row per label is collected
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    return train(got["text"].tolist(), got["toxic"].astype(int).tolist())


def _scored(batches, model, name):
    import pyarrow as pa

    for b in batches:
        for part in slices(b, "text"):
            score = model.scores([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])


def with_scores(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """docs and a column of scores; other columns pass through as they are."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(lambda batches: _scored(batches, model, name), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    model = fit(docs, labels, **options)
    out = with_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without rows scored 0.5 or more."""
    name = "_score" + "_" * max(map(len, docs.columns))  # longer than any name in use
    return with_scores(docs, fit(docs, labels, **options), name).where(F.col(name) < 0.5).drop(name)
