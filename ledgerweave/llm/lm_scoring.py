"""Language-model scores of whole texts by a log-bilinear model, trained with noise-contrastive estimation."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import bucket, read, record, slices, stored, utf8

#: Words of which every worker holds the count. Rarer ones are joined, so this bounds memory and changes no result.
HELD_WORDS = 131_072
#: Output classes of the model: the most frequent words, one class each, the end, and the rest by their last three bytes.
HEAD_WORDS = 1_535
TAIL_CLASSES = 512
CLASSES = HEAD_WORDS + 1 + TAIL_CLASSES
END, START = HEAD_WORDS, CLASSES
WIDTH = 24
NOISE = 32
BATCH = 4096
RATE = 0.05
#: Tasks whose parameters are summed in one.
FAN_IN = 16
#: Distinct words that a task counts before it hands them on.
FLUSH_WORDS = 300_000


def tail_class(word: bytes) -> int:
    return HEAD_WORDS + 1 + zlib.crc32(word[-3:]) % TAIL_CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), c: how often each word stands in all of docs (text). Counted inside tasks first, then over all."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in utf8(batch, "text"):
                seen.update(text.lower().split())
            if len(seen) > FLUSH_WORDS:
                yield record(schema, word=list(seen), c=list(seen.values()))
                seen.clear()
        if seen:
            yield record(schema, word=list(seen), c=list(seen.values()))

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Counts that every worker holds, and the parameters: context vectors by distance, output vectors, output biases."""

    n_tokens: int
    n_distinct: int
    n_ends: int
    words: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    parameters: tuple[np.ndarray, ...] = ()
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def lookup(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}

    def classes(self) -> np.ndarray:
        """The class of each held word, and of the end after them."""
        tails = [tail_class(w) for w in self.words[HEAD_WORDS:]]
        return np.array([*range(min(HEAD_WORDS, len(self.words))), *tails, END], np.int64)

    def inside(self) -> np.ndarray:
        """log10 of what the counts (c + 1) of a class's words sum to, one unseen word included; 0 for classes of one word."""
        out = np.zeros(CLASSES)
        out[END + 1 :] = np.log10(self.class_tokens + self.class_words + 1)
        return out

    def shares(self) -> np.ndarray:
        n = np.ones(CLASSES)
        head = self.counts[:HEAD_WORDS]
        n[: len(head)] += head
        n[END] += self.n_ends
        n[END + 1 :] += self.class_tokens
        return n / n.sum()

    def start(self, seed: int = 5) -> tuple[np.ndarray, ...]:
        rng = np.random.default_rng(seed)
        first = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        return first(CLASSES + 1), first(CLASSES + 1), first(CLASSES), np.log(self.shares()).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, ...]:
        """log p(w | c1, c2) = near[c1, w] + far[c2, w] + bias[w] - norm[c1, c2], normalised over all classes by matrix products."""
        r1, r2, q, b = self.parameters
        near, far = r1 @ q.T, r2 @ q.T
        top1 = near.max(1)
        with_bias = far + b
        top2 = with_bias.max(1)
        norm = np.exp(near - top1[:, None]) @ np.exp(with_bias - top2[:, None]).T
        return near, far, b, np.log(norm) + top1[:, None] + top2[None, :]


def gather(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model before training, and the stored counts of all words of docs."""
    counts = stored(count_words(docs))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = docs.count()
    # words of the highest magnitudes (eighths of a power of two) that together are HELD_WORDS at most: no task sorts them all
    magnitude = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(magnitude.alias("m")).count().collect()), reverse=True)
    reach = np.cumsum([n for _, n in sizes]) <= HELD_WORDS
    least = sizes[int(reach.sum()) - 1][0] if reach.any() else 1 << 30
    held = counts.where(magnitude >= least).toArrow()
    ranked = sorted(zip((-held.column("c").to_numpy()).tolist(), map(bytes, held.column("word").to_pylist()), strict=True))
    words, c = [w for _, w in ranked], np.array([-n for n, _ in ranked], np.int64)
    tokens, distinct = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    suffix = F.when(F.length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))
    for row in counts.groupBy(F.pmod(F.crc32(suffix), F.lit(TAIL_CLASSES)).alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[row["g"]], distinct[row["g"]] = row["n"], row["v"]
    for w, n in zip(words[:HEAD_WORDS], c[:HEAD_WORDS].tolist(), strict=True):
        g = tail_class(w) - END - 1
        tokens[g] -= n
        distinct[g] -= 1
    return Model(int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends, words, c, tokens, distinct), counts


_held: dict[str, tuple] = {}


def _of(model: Model, make):
    """What make(model) gives, once for each worker and model."""
    if model.key not in _held:
        _held.clear()
        _held[model.key] = (model.lookup(), model.classes(), make(model))
    return _held[model.key]


def _streams(texts: list[bytes], lookup: dict[bytes, int], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Of some texts, each with its end: held-word numbers (-1: none), classes, the words that aren't held, and tokens by text."""
    get, end = lookup.get, len(classes) - 1
    ids, rare, sizes = [], [], []
    for text in texts:
        words = text.lower().split()
        own = [get(w, -1) for w in words]
        if -1 in own:
            rare += [w for w, k in zip(words, own, strict=True) if k < 0]
        own.append(end)
        ids += own
        sizes.append(len(own))
    ids = np.array(ids, np.int64)
    kinds = classes[ids]
    if rare:
        kinds[ids < 0] = [tail_class(w) for w in rare]
    return ids, kinds, rare, np.array(sizes, np.int64)


def _contexts(kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    firsts = np.cumsum(sizes) - sizes
    one = np.empty_like(kinds)
    one[1:] = kinds[:-1]
    one[firsts] = START
    two = np.empty_like(kinds)
    two[1:] = one[:-1]
    two[firsts] = START
    return one, two


class Trainer:
    """Noise-contrastive estimation with Adagrad; a batch shares its noise, so that scores are matrix products."""

    def __init__(self, model: Model, seed: int):
        self.p = [x.copy() for x in model.start()]
        self.past = [np.full_like(x, 1e-4) for x in self.p]
        shares = model.shares()
        self.log_noise = (np.log(shares) + np.log(NOISE)).astype(np.float32)
        self.edges = np.cumsum(shares)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    @staticmethod
    def _sum_by(keys: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        order = np.argsort(keys.astype(np.int16), kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out = np.zeros((rows, values.shape[1]), np.float32)
        out[keys[first]] = np.add.reduceat(values[order], first)
        return out

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        r1, r2, q, b = self.p
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), CLASSES - 1)
        h = r1[one] + r2[two]
        true = np.einsum("ij,ij->i", h, q[word]) + b[word] - self.log_noise[word]
        false = h @ q[noise].T + (b[noise] - self.log_noise[noise])
        g_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        g_false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        gh = g_true[:, None] * q[word] + g_false @ q[noise]
        gq = self._sum_by(word, g_true[:, None] * h, CLASSES)
        np.add.at(gq, noise, g_false.T @ h)
        gb = np.bincount(word, g_true, CLASSES) + np.bincount(noise, g_false.sum(0), CLASSES)
        for p, past, g in zip(self.p, self.past, (self._sum_by(one, gh, CLASSES + 1), self._sum_by(two, gh, CLASSES + 1), gq, gb.astype(np.float32)), strict=True):
            past += g * g
            p -= RATE * g / np.sqrt(past)
        self.tokens += len(word)


def train(model: Model, docs: DataFrame) -> Model:
    """Train on every token of docs (text): tasks train on their own part from one start, and the mean by tokens is taken.

    Each task's noise and order are seeded by its number, so the scores depend, slightly, on how the rows are dealt over
    tasks; for the same partitions they are the same.

    Parameters are summed level by level, so neither a task nor the driver gets those of many more than FAN_IN tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("p", pa.binary()), ("n", pa.int64())])

    def run(batches):
        lookup, classes, _ = _of(shared.value, lambda m: None)
        trainer = None
        for batch in slices(batches):
            if trainer is None:
                trainer = Trainer(shared.value, 17 + TaskContext.get().partitionId())
            _, kinds, _, sizes = _streams(utf8(batch, "text"), lookup, classes)
            one, two = _contexts(kinds, sizes)
            order = trainer.rng.permutation(len(kinds))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                trainer.step(kinds[pick], one[pick], two[pick])
        if trainer is not None and trainer.tokens:
            flat = np.concatenate([x.ravel() for x in trainer.p])
            yield record(schema, p=[(flat * np.float64(trainer.tokens)).tobytes()], n=[trainer.tokens])

    def add(batches):
        total, n = None, 0
        for batch in slices(batches, 1):
            flat = np.frombuffer(batch.column("p")[0].as_py(), np.float64)
            total = flat if total is None else total + flat
            n += batch.column("n")[0].as_py()
        if n:
            yield record(schema, p=[total.tobytes()], n=[n])

    parts, left = docs.select("text").mapInArrow(run, "p binary, n long"), docs.rdd.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(add, "p binary, n long")
    sums = parts.collect()
    start = model.start()
    if sums:
        flat = sum(np.frombuffer(r["p"], np.float64) for r in sums) / sum(r["n"] for r in sums)
        at = np.cumsum([x.size for x in start])[:-1]
        start = tuple(x.reshape(s.shape).astype(np.float32) for x, s in zip(np.split(flat, at), start, strict=True))
    model.parameters = start
    model.key = uuid.uuid4().hex
    return model


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) for each row of docs (doc_id, text), over the whole text.

    A text is its words and one end; a null text is the end alone. score is the sum of log10 p(class | two classes before)
    and, in classes of several words, log10 of (c + 1) over the class's sum, in which one unseen word has its share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            m = shared.value
            lookup, classes, (near, far, bias, norm) = _of(m, Model.tables)
            inside = m.inside()
            known = np.r_[m.counts, m.n_ends, 0]  # the last: words that aren't held
            ids, kinds, rare, sizes = _streams(utf8(batch, "text"), lookup, classes)
            firsts = np.cumsum(sizes) - sizes
            one, two = _contexts(kinds, sizes)
            logs = np.log10(known[ids] + 1.0)
            model_logs = (near[one, kinds] + far[two, kinds] + bias[kinds] - norm[one, two]) / np.log(10)
            model_logs = model_logs.astype(np.float64) - inside[kinds] + np.where(kinds > END, logs, 0)
            lost = np.add.reduceat((ids < 0).astype(np.int64), firsts)
            cuts = np.cumsum(lost) - lost
            yield record(
                _SCORED, row=batch.column("row"), doc_id=batch.column("doc_id"), n_tokens=sizes, n_known=np.add.reduceat((known[ids] > 0).astype(np.int64), firsts),
                base=np.add.reduceat(logs, firsts), score=np.add.reduceat(model_logs, firsts), rare=[rare[s : s + n] for s, n in zip(cuts.tolist(), lost.tolist(), strict=True)],
            )

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    scored = stored(own.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<binary>"))
    rare = scored.select("row", F.explode("rare").alias("word"))
    more = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    logs, n = F.coalesce("logs", F.lit(0.0)), F.lit(float(model.n_tokens + model.n_distinct + 1))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * F.log10(n)).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, base_score and score of every document, learned from those that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.where(bucket("doc_id", 7) != 2)
    model, counts = gather(learn)
    scored = score(docs, train(model, learn), counts)
    return scored.select("doc_id", (bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
