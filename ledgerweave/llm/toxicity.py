"""Toxic texts by a convolutional classifier over hashed word embeddings, with thresholds calibrated by language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import SLICE_ROWS, bucket, read

#: Labelled rows drawn at most, by the hash of their ids. One in CALIBRATION of them isn't fitted on but sets the thresholds.
TRAIN_ROWS = 8000
CALIBRATION = 5
BUCKETS = 1 << 17
WIDTH = 12
#: A word is embedded as a whole and by its first bytes, so that forms of one stem share what is learned.
PREFIXES = (4, 5, 6)
#: Filters of each width in words.
FILTERS = {1: 8, 2: 4, 3: 4}
EPOCHS = 4
RATE = 0.05
THRESHOLD = 0.5
#: Words whose buckets a task keeps before it forgets them all.
CACHE_WORDS = 200_000

_WORD = re.compile(rb"[a-z\x80-\xff]+")
_PAD = max(FILTERS) - 1


def buckets_of(word: bytes) -> tuple[int, ...]:
    return (zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS for n in PREFIXES))


def words_of(text: bytes, cache: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Buckets of each word of a text, followed by empty places (-1) as wide as the widest filter reaches."""
    out = []
    for w in _WORD.findall(text.lower()):
        found = cache.get(w)
        if found is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            found = cache[w] = buckets_of(w)
        out.append(found)
    return np.array(out + [(-1,) * (1 + len(PREFIXES))] * (1 + _PAD), np.int32)


class TextConvolution:
    """Embedding sums, filters of several widths, maxima over the text, one logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.embedding = normal(BUCKETS + 1, WIDTH) * 0.1
        self.embedding[-1] = 0  # empty places
        self.filters = {k: normal(k, WIDTH, n) for k, n in FILTERS.items()}
        for k in FILTERS:
            self.filters[k][0, 0] = np.abs(self.filters[k][0, 0]) + 0.5  # the first dimension starts as each bucket's log odds
        self.bias = {k: np.zeros(n, np.float32) for k, n in FILTERS.items()}
        self.out = np.full(sum(FILTERS.values()), 0.3, np.float32)
        self.out_bias = np.full(1, -2, np.float32)
        self.thresholds: dict[str, float] = {}

    def _pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pooled outputs, the place of each maximum, all places' embeddings and their buckets."""
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        x = self.embedding[flat[:, 0]].copy()
        for k in range(1, flat.shape[1]):
            x += self.embedding[flat[:, k]]
        pooled, places = [], []
        for k, w in self.filters.items():
            y = x @ w[0]
            for j in range(1, k):
                y[:-j] += (x @ w[j])[j:]
            for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                own = y[s : s + n - _PAD]
                at = own.argmax(0)
                pooled.append(own[at, np.arange(own.shape[1])])
                places.append(at + s)
        shape = lambda parts: np.concatenate([np.stack(parts[i * len(texts) : (i + 1) * len(texts)]) for i in range(len(FILTERS))], 1)
        return shape(pooled) + np.concatenate(list(self.bias.values())), shape(places), x, flat

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        raw = np.maximum(self._pooled(texts)[0], 0) @ self.out + self.out_bias[0]
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> TextConvolution:
        toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for text, y in zip(texts, labels, strict=True):
            seen = np.unique(text[text >= 0])
            (toxic if y else clean)[seen] += 1
        odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / ((1 - labels).sum() + 1))
        seen = toxic + clean
        self.embedding[:-1, 0] = np.clip(odds / 4, -1, 1) * np.where(seen > 2, seen / (seen + 4), 0)  # rare buckets say little
        rng = np.random.default_rng(13)
        past: dict[int, np.ndarray] = {}

        def move(param: np.ndarray, g: np.ndarray, where=slice(None)) -> None:
            sums = past.setdefault(id(param), np.full(param.shape, 1e-4, np.float32))
            sums[where] += g * g
            param[where] -= RATE * g / np.sqrt(sums[where])

        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 32):
                pick = order[at : at + 32]
                own = [texts[i] for i in pick]
                pooled, places, x, flat = self._pooled(own)
                hidden = np.maximum(pooled, 0)
                error = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias[0], -30, 30))) - labels[pick]
                error = (error / len(own)).astype(np.float32)
                g_hidden = error[:, None] * self.out * (pooled > 0)
                move(self.out, hidden.T @ error)
                move(self.out_bias, error.sum(keepdims=True))
                first, touched, steps = 0, [], []
                for k, w in self.filters.items():
                    g, where = g_hidden[:, first : first + w.shape[2]], places[:, first : first + w.shape[2]]
                    first += w.shape[2]
                    gw = np.zeros_like(w)
                    for j in range(k):
                        seen = x[where + j]  # texts, filters, WIDTH
                        gw[j] = np.einsum("tfd,tf->df", seen, g)
                        touched.append(flat[(where + j).ravel()])
                        steps.append((g[:, :, None] * w[j].T[None]).reshape(-1, WIDTH))
                    move(w, gw)
                    move(self.bias[k], g.sum(0))
                rows, steps = np.concatenate(touched), np.concatenate(steps)
                live = np.abs(steps).max(1) > 0
                rows, steps = rows[live], steps[live]
                if len(rows):
                    used, inverse = np.unique(rows, return_inverse=True)
                    g = np.zeros((len(used), WIDTH), np.float32)
                    for j in range(rows.shape[1]):
                        np.add.at(g, inverse.reshape(rows.shape)[:, j], steps)
                    move(self.embedding, g[used >= 0], used[used >= 0])
        return self

    def calibrate(self, scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
        """Of each language with both labels, the score that parts them with the best F1; others keep THRESHOLD."""
        langs = np.array([x or "" for x in langs])
        for lang in np.unique(langs).tolist():
            s, y = scores[langs == lang], labels[langs == lang]
            if lang and 0 < y.sum() < len(y):
                order = np.argsort(-s, kind="stable")
                hits = np.cumsum(y[order])
                f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
                k = int(f1.argmax())
                below = s[order[k + 1]] if k + 1 < len(s) else 0.0
                self.thresholds[lang] = float((s[order[k]] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> TextConvolution:
    """Fit on the whole texts of at most rows labels, drawn by the hash of doc_id.

    docs: doc_id, text, lang; labels: doc_id and the label. One drawn row in CALIBRATION is held out: the model's scores of
    these set the thresholds by language. lang only serves those. Rows with a null label or id teach nothing; without rows
    every text gets the same low score. The drawn labels, no more than rows, are broadcast, so that only their texts are
    shuffled, and these come to the driver; of rows with one id, the least text counts.
    """
    drawn = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(F.broadcast(drawn), "doc_id")
    least = chosen.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("d"))
    held = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION)) == 0
    found = least.select("doc_id", "y", F.col("d.text").cast("binary").alias("text"), "d.lang", held.alias("held")).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    model = TextConvolution()
    if found.num_rows:
        cache: dict[bytes, tuple[int, ...]] = {}
        texts, y = [words_of(t, cache) for t in found.column("text").to_pylist()], found.column("y").to_numpy().astype(np.float64)
        held, langs = found.column("held").to_numpy(zero_copy_only=False), found.column("lang").to_pylist()
        if not held.all():
            model.fit([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
        if held.any():
            kept = [t for t, h in zip(texts, held, strict=True) if h]
            scores = np.concatenate([model.scores(kept[at : at + SLICE_ROWS]) for at in range(0, len(kept), SLICE_ROWS)])
            model.calibrate(scores, y[held], [x for x, h in zip(langs, held, strict=True) if h])
    return model


def score(docs: DataFrame, model: TextConvolution, into: str = "score") -> DataFrame:
    """docs with every column and the score (0 to 1, higher: toxic likelier) in the column into, which is replaced if there. Only the text is read, the whole of it; null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[bytes, tuple[int, ...]] = {}
        for text in batches:
            parts = [text.iloc[at : at + 64] for at in range(0, len(text), 64)]
            out = [shared.value.scores([words_of((t or "").encode(), cache) for t in part]) for part in parts]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(into, F.pandas_udf(scored, "double")("text"))


def flagged(model: TextConvolution, score_column: str, lang_column: str) -> Column:
    """Whether a score reaches the threshold that was calibrated for the row's language (THRESHOLD for others and null)."""
    limit = F.lit(THRESHOLD)
    for lang, threshold in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang_column) == lang, F.lit(threshold)).otherwise(limit)
    return F.col(score_column) >= limit


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and flagged (by the language's threshold) of every document."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0))
    scored = score(docs.select("doc_id", "text", "lang"), model)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select(F.col("doc_id").cast("long"), (bucket("doc_id", 5) == 0).alias("held_out"), "score", predicted, flagged(model, "score", "lang").alias("flagged"))
