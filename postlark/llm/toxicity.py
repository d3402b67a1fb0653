"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embedding rows: of the word and of its first
5, 6 and 7 bytes, so that inflected forms share a part.  Filters of several widths
run over the words, each keeps its maximum over the whole text, and a logistic
unit reads the maxima.  The model is fitted on the driver from a bounded sample of
labelled rows and has a fixed size; scoring is a column over all documents.
Language is no input of the score; it only picks the threshold of ``toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.llm.words import find_words, hash_prefixes, hash_words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
PREFIXES = (5, 6, 7)
#: Labelled rows of each class that a fit uses at most.
SAMPLE_PER_CLASS = 2500
EPOCHS, DOCS_PER_STEP = 6, 64
#: Words scored at once bound a worker's memory; longer texts are scored in overlapping runs.
WORDS_AT_ONCE = 1 << 17


class Model(NamedTuple):
    embedding: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # one for each width: (width * dim) x filters
    filter_bias: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float]


def word_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words (words x features), and where each text's words begin."""
    words = find_words(texts)
    hashes = [hash_words(words), *(hash_prefixes(words, n) for n in PREFIXES)]
    return np.stack([(h >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1) for h in hashes], 1), words.bounds


def _vectors(embedding: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = embedding[rows[:, 0]].copy()
    for k in range(1, rows.shape[1]):
        out += embedding[rows[:, k]]
    return out


def _pooled(model: Model, vectors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima of the rectified filters for each text, and for each width the words where they begin."""
    n, pad = len(bounds) - 1, max(WIDTHS) - 1
    padded = np.concatenate([vectors, np.zeros((pad, DIM), np.float32)])
    text = np.repeat(np.arange(n), np.diff(bounds))
    full = np.nonzero(np.diff(bounds) > 0)[0]
    pooled, places = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), []
    for j, (width, filters, bias) in enumerate(zip(WIDTHS, model.filters, model.filter_bias, strict=True)):
        out = vectors @ filters[:DIM] + bias
        for k in range(1, width):  # words after a text's end count as zero vectors
            after = padded[k:k + len(vectors)] @ filters[k * DIM:(k + 1) * DIM]
            after[np.nonzero(np.r_[text[k:], np.full(min(k, len(text)), -1)] != text)[0]] = 0
            out += after
        if len(full):
            pooled[full, j * FILTERS:(j + 1) * FILTERS] = np.maximum.reduceat(out, bounds[full], axis=0)
        places.append(out)
    return np.maximum(pooled, 0), places


def logits(model: Model, texts: list[str | None]) -> np.ndarray:
    rows, bounds = word_rows(texts)
    out, start = np.full(len(texts), model.bias, np.float32), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + WORDS_AT_ONCE)) - 1)
        stop = min(stop, len(texts))
        part = rows[bounds[start]:bounds[stop]]
        if len(part) > WORDS_AT_ONCE:  # one very long text: maxima of overlapping runs
            best = np.zeros(FILTERS * len(WIDTHS), np.float32)
            for i in range(0, len(part), WORDS_AT_ONCE):
                run = part[i:i + WORDS_AT_ONCE + max(WIDTHS) - 1]
                best = np.maximum(best, _pooled(model, _vectors(model.embedding, run), np.array([0, len(run)]))[0][0])
            out[start] += best @ model.weights
        else:
            out[start:stop] += _pooled(model, _vectors(model.embedding, part), bounds[start:stop + 1] - bounds[start])[0] @ model.weights
        start = stop
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """Train, then move the bias so that 0.5 separates best on rows kept aside; thresholds by language likewise."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    rows, bounds = word_rows(texts)
    aside = rng.random(len(y)) < 0.2
    train = np.nonzero(~aside)[0]
    text = np.repeat(np.arange(len(y)), np.diff(bounds))

    # Embeddings start from the log-odds of a bucket's documents in their first dimension, noise elsewhere.
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    counts = np.zeros((2, BUCKETS))
    for k in range(rows.shape[1]):
        pairs = np.unique(text.astype(np.int64) * BUCKETS + rows[:, k])
        pairs = pairs[~aside[pairs // BUCKETS]]
        np.add.at(counts, (y[pairs // BUCKETS].astype(int), pairs % BUCKETS), 1)
    of = [max(1, int((y[train] == c).sum())) for c in (0, 1)]
    odds = np.log((counts[1] + 0.5) / (of[1] + 1)) - np.log((counts[0] + 0.5) / (of[0] + 1))
    embedding[:, 0] = 0.25 * np.clip(odds, -4, 4) * (counts.sum(0) > 2)
    filters = [rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0::DIM] += 0.5
    model = Model(embedding, filters, [np.full(FILTERS, -0.2, np.float32) for _ in WIDTHS], rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, {})
    bias, rate = -1.0, 0.05
    squares = {"e": np.full(BUCKETS, 1e-3, np.float32), "b": 1e-3, "w": np.full(len(model.weights), 1e-3, np.float32)} | {("f", j): np.full(f.shape, 1e-3, np.float32) for j, f in enumerate(filters)}
    # Classes weigh alike: a fit on few positives would else answer no.
    balance = np.where(y == 1, len(train) / (2 * of[1]), len(train) / (2 * of[0])).astype(np.float32)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // DOCS_PER_STEP)):
            size = np.diff(bounds)[batch]
            inner = np.r_[0, np.cumsum(size)]
            part = rows[np.repeat(bounds[batch] - inner[:-1], size) + np.arange(inner[-1])]
            vectors = _vectors(embedding, part)
            pooled, outs = _pooled(model, vectors, inner)
            error = (_sigmoid(pooled @ model.weights + bias) - y[batch]) * balance[batch] / len(batch)
            back = np.outer(error, model.weights) * (pooled > 0)
            gradient = pooled.T @ error
            squares["w"] += gradient**2
            model.weights[:] -= rate * gradient / np.sqrt(squares["w"])
            squares["b"] += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(squares["b"])
            touched, deltas = [], []
            for j, width in enumerate(WIDTHS):
                move = np.zeros_like(filters[j])
                for d in np.nonzero(size)[0]:
                    g = back[d, j * FILTERS:(j + 1) * FILTERS]
                    live = np.nonzero(g)[0]
                    if not len(live):
                        continue
                    at = outs[j][inner[d]:inner[d + 1], live].argmax(0) + inner[d]
                    for k in range(width):
                        inside = at + k < inner[d + 1]
                        a, f = at[inside] + k, live[inside]
                        move[k * DIM:(k + 1) * DIM, f] += (vectors[a] * g[f, None]).T
                        touched.append(part[a].ravel())
                        deltas.append(np.repeat(filters[j][k * DIM:(k + 1) * DIM, f].T * g[f, None], part.shape[1], 0))
                squares["f", j] += move**2
                filters[j] -= rate * move / np.sqrt(squares["f", j])
            if touched:
                where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(where), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(deltas))
                squares["e"][where] += (total**2).sum(1)
                embedding[where] -= rate * total / np.sqrt(squares["e"][where])[:, None]
    model = model._replace(bias=float(bias))
    held = np.nonzero(aside)[0] if aside.any() else np.arange(len(y))
    found, kinds = logits(model, [texts[i] for i in held]), np.array([langs[i] or "" for i in held])
    cut = _best_cut(found, y[held])
    model = model._replace(bias=model.bias - cut)
    thresholds = {}
    for lang in sorted(set(kinds.tolist())):
        mine = kinds == lang
        if min(y[held][mine].sum(), (1 - y[held][mine]).sum()) >= 10:
            thresholds[lang] = float(_sigmoid(_best_cut(found[mine], y[held][mine]) - cut))
    return model._replace(thresholds=thresholds)


def _best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates best (balanced accuracy), in the middle of the gap around it."""
    if len(np.unique(y)) < 2:
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], y[order]
    right = np.r_[0, np.cumsum(t == 0)] / (t == 0).sum() + np.r_[np.cumsum((t == 1)[::-1])[::-1], 0] / (t == 1).sum()
    right[1:-1][s[1:] == s[:-1]] = -1
    best = np.nonzero(right >= right.max() - 1e-9)[0]
    i = int(best[len(best) // 2])
    low, high = (s[i - 1] if i else s[0] - 1), (s[i] if i < len(s) else s[-1] + 1)
    return float((low + high) / 2)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, taken evenly by a hash of the id; held-out ids never.

    Rows without id or label are no examples.  Without any example the model scores all texts alike.
    """
    given = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    order = (F.xxhash64("__id"), "__id")
    picked = given.where("__y = 1").orderBy(*order).limit(per_class).union(given.where("__y = 0").orderBy(*order).limit(per_class))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), lang.alias("__lang")).join(F.broadcast(picked), "__id")
    # An id that repeats counts once, with its smallest text: 2 x per_class rows at most reach the driver.
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct("__text", "__lang")).alias("t")).select("__id", "__y", "t.*").collect()
    rows.sort(key=lambda r: (r["__id"], r["__text"] or ""))
    return fit([r["__text"] or "" for r in rows], np.array([r["__y"] for r in rows]), [r["__lang"] for r in rows])


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Add ``score`` (0 to 1) and ``toxic`` (the language's threshold is reached; 0.5 for languages without one).

    Null and empty texts have a score too: that of a text without words.  All rows and columns stay; those of
    the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x DIM floats

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [_sigmoid(logits(shared.value, texts.iloc[i:i + 256].tolist()).astype(np.float64)) for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    out = docs.withColumn("score", score(F.col(text_col).cast("string")))
    limit = F.lit(0.5)
    if lang_col in docs.columns and model.thresholds:
        levels = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair))
        limit = F.coalesce(F.element_at(levels, F.col(lang_col)), F.lit(0.5))
    return out.withColumn("toxic", F.col("score") >= limit)
