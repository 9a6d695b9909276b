"""Document quality by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerweave.llm.common import SLICE_ROWS, bucket, columns_of, read, record, slices, unused

#: Labelled rows that the model is fitted on at most, drawn by the hash of their ids.
TRAIN_ROWS = 6000
WORD_BUCKETS = 1 << 15
RANK = 6
EPOCHS = 6
THRESHOLD = 0.3
STATISTICS = 14
#: Places of metadata: values of text columns are hashed into them, each number has one.
META_BUCKETS = 1024
#: Metadata that the query reads beside the text.
METADATA = ("n_chars",)

_PUNCTUATION = b".,;:!?"
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@{}[]\\^~_=+"
_UPPER = bytes(range(65, 91))


def statistics(text: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text and its size, each about 0 to 1."""
    size, n = len(text) or 1, len(words) or 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    same_next = sum(a == b for a, b in pairwise(words)) / n
    bare = sum(not w.translate(None, _SYMBOLS) for w in words) / n
    ends = sum(w[-1] in _SYMBOLS or w[-1] in b"!?" for w in words) / n
    return [
        np.log1p(n) / 10, size / n / 20, 1 - len(set(words)) / n, same_next, bare, ends, 10 * share(_SYMBOLS), 10 * share(_PUNCTUATION), 10 * share(_DIGITS),
        10 * share(_UPPER), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 6, np.log1p(len(lines)) / 6, float(not words),
    ]


def metadata_features(values: Sequence[str | None], columns: Sequence[tuple[str, bool]]) -> list[tuple[int, float]]:
    """Feature ids and values of a row's metadata (as text). columns: name, and whether it is a number. Nulls give none."""
    out = []
    for value, (name, number) in zip(values, columns, strict=True):
        if value is None:
            continue
        if not number:
            out.append((WORD_BUCKETS + STATISTICS + zlib.crc32(f"{name}={value}".encode()) % META_BUCKETS, 1.0))
            continue
        size = float(value)
        if size == size:
            out.append((WORD_BUCKETS + STATISTICS + zlib.crc32(name.encode()) % META_BUCKETS, float(np.copysign(np.log1p(min(abs(size), 1e300)), size)) / 10))
    return out


def features(text: bytes, cache: dict[bytes, int] | None = None, more: Sequence[tuple[int, float]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values of a text: its distinct hashed words, of equal weight and unit length, its statistics, and more."""
    words = text.split()
    stats = statistics(text, words)
    cache = {} if cache is None else cache
    ids = set()
    for w in set(words):
        b = cache.get(w)
        if b is None:
            if len(cache) > 300_000:
                cache.clear()
            b = cache[w] = zlib.crc32(w) % WORD_BUCKETS
        ids.add(b)
    hashed = np.fromiter(sorted(ids), np.int64, len(ids))
    value = np.full(len(hashed), 1 / max(1, len(hashed)) ** 0.5)
    return np.concatenate([hashed, WORD_BUCKETS + np.arange(STATISTICS), [k for k, _ in more]]).astype(np.int64), np.concatenate([value, stats, [v for _, v in more]])


class FactorisationMachine:
    """w0 + sum w x + the pairwise interactions of rank RANK, by the identity (sum v x)^2 - sum v^2 x^2 in linear time.

    An unfitted model gives one half to every row. metadata: the columns that it reads beside the text.
    """

    def __init__(self, seed: int = 7, metadata: Sequence[tuple[str, bool]] = ()):
        self.seed, self.metadata = seed, tuple(metadata)
        n = WORD_BUCKETS + STATISTICS + META_BUCKETS
        self.w0, self.w = np.zeros(1), np.zeros(n)
        self.v = np.zeros((n, RANK), np.float32)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self._raw(rows)[0], -30, 30)))

    def _raw(self, rows):
        ids, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        vx = self.v[ids] * x[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return self.w0[0] + np.add.reduceat(self.w[ids] * x, starts) + pairs, ids, x, vx, total

    def fit(self, rows, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-5) -> FactorisationMachine:
        self.v = np.random.default_rng(self.seed).normal(0, 0.05, self.v.shape).astype(np.float32)
        rng = np.random.default_rng(11)
        grads = [np.full_like(p, 1e-6, dtype=np.float64) for p in (self.w0, self.w, self.v)]
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.w0[0] = np.log(share / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), 64):
                pick = order[at : at + 64]
                own = [rows[k] for k in pick]
                raw, ids, x, vx, total = self._raw(own)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]
                each = np.repeat(np.arange(len(own)), [len(r[0]) for r in own])
                e = error[each]
                used, inverse = np.unique(ids, return_inverse=True)
                gw = np.bincount(inverse, e * x) + decay * self.w[used]
                gv = np.stack([np.bincount(inverse, e * x * (total[each, k] - vx[:, k])) for k in range(RANK)], 1) + decay * self.v[used]
                for grad, param, g, where in ((grads[0], self.w0, error.sum(keepdims=True), [0]), (grads[1], self.w, gw, used), (grads[2], self.v, gv, used)):
                    grad[where] += g**2
                    param[where] -= rate * g / np.sqrt(grad[where])
        return self


def _metadata(columns: Sequence[str]) -> Column:
    return F.array(*(F.col(c).cast("string") for c in columns)) if columns else F.array().cast("array<string>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, metadata: Sequence[str] = ()) -> FactorisationMachine:
    """Fit on the whole texts, and the named columns of docs, of at most rows labels, drawn by the hash of doc_id.

    docs: doc_id, text and metadata; labels: doc_id and the label (0 or 1). Null labels or ids teach nothing. Without rows
    the model is unfitted; with one label only it leans to it for every text. The drawn labels, no more than rows, are
    broadcast; of rows with one id, the least text counts, and only its features come to the driver.
    """
    drawn = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    columns = [(c, isinstance(docs.schema[c].dataType, NumericType)) for c in metadata]
    chosen = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), _metadata(metadata).alias("more")).alias("d")).join(F.broadcast(drawn), "doc_id")
    least = chosen.groupBy("doc_id", "y").agg(F.min("d").alias("d")).select("doc_id", "y", F.col("d.text").cast("binary").alias("text"), "d.more")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("ids", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for batch in slices(batches):
            found = [features(t, None, metadata_features(m, columns)) for t, m in zip(batch.column("text").to_pylist(), batch.column("more").to_pylist(), strict=True)]
            yield record(schema, doc_id=batch.column("doc_id"), y=batch.column("y"), ids=[i for i, _ in found], x=[x for _, x in found])

    found = least.select(F.col("doc_id").cast("long"), "y", "text", "more").mapInArrow(run, "doc_id long, y int, ids array<int>, x array<float>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    model = FactorisationMachine(metadata=columns)
    if found.num_rows:
        ids, x = (found.column(c).combine_chunks() for c in ("ids", "x"))
        cuts = np.cumsum(pc.list_value_length(ids).to_numpy())[:-1]
        rows = zip(*(np.split(part.flatten().to_numpy(), cuts) for part in (ids, x)), strict=True)
        model.fit(list(rows), found.column("y").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: FactorisationMachine, into: str = "score") -> DataFrame:
    """docs with every column and the score (0 to 1, higher: label 1 likelier) in the column into, which it replaces if there.

    Only the text and the model's metadata columns are read. Null texts are scored as empty ones; equal rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict[bytes, int] = {}
        columns = shared.value.metadata
        for text, more in batches:
            parts = [slice(at, at + SLICE_ROWS) for at in range(0, len(text), SLICE_ROWS)]
            rows = lambda part: zip(text.iloc[part], more.iloc[part], strict=True)  # noqa: B023, E731
            out = [shared.value.scores([features((t or "").encode(), cache, metadata_features(m, columns)) for t, m in rows(part)]) for part in parts]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(into, F.pandas_udf(scored, "double")(F.col("text"), _metadata([c for c, _ in model.metadata])))


def _training(labels: DataFrame) -> DataFrame:
    return labels.where(bucket("doc_id", 5) != 0)


def accept(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ()) -> DataFrame:
    """The rows of docs that the model trained on labels predicts to be good; columns are those of docs, whatever their names."""
    model = train(docs, _training(labels), metadata=metadata)
    into = unused(docs.columns, "quality_score")
    return score(docs, model, into).where(F.col(into) >= THRESHOLD).select(*columns_of(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from its text and n_chars."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, _training(read(spark, sf_dir, "labels")), metadata=METADATA)
    scored = score(docs.select("doc_id", "text", *METADATA), model, "score")
    return scored.select(F.col("doc_id").cast("long"), (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
