"""Language identification by cross-parsing: suffix automata of labelled text, and the fewest longest-match phrases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import SLICE_ROWS, bucket, read

#: Symbols of labelled text per language at most, and the size of all automata together, which lowers that for many languages.
TRAIN_SYMBOLS = 60_000
MODEL_BYTES = 256 << 20
#: Symbols parsed side by side as one block, and blocks at once.
BLOCK = 512
WAVE = 8192
UNKNOWN = "und"
#: Letters of one symbol each. A rarer letter is seven symbols, the octal digits of its code point, so none are confused.
ALPHABET = 54
DIGITS = 8
#: Training texts below this length are taken to say as much a phrase as one of this length.
LEAST_LENGTH = 4096


def normalised(text: str) -> str:
    """Lower case, with one space for each run of what isn't a letter."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


def automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: states by symbols, 0 where there is none; state 1 is the root."""
    to: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.zeros((len(to), width), np.int32)
    for state, edges in enumerate(to):
        for c, target in edges.items():
            table[state, c] = target
    return table


@dataclass
class Parser:
    """Symbols by code point, and the automata of all languages in one table; a step that starts a new phrase is negative.

    Each language's first state is the one before any symbol and after a symbol that its text lacks: all steps from it
    start a phrase.
    """

    langs: list[str]
    letters: np.ndarray
    table: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def sample_symbols(langs: int) -> int:
        """Symbols of each of so many languages' texts, so that all automata (two states a symbol at most) fit MODEL_BYTES."""
        return min(TRAIN_SYMBOLS, MODEL_BYTES // (max(langs, 1) * 2 * 4 * (DIGITS + ALPHABET)))

    @staticmethod
    def fit(samples: dict[str, list[str]]) -> Parser:
        """samples: texts of each language, used in order until its share of symbols is full."""
        size = Parser.sample_symbols(len(samples))
        joined = {lang: " ".join(filter(None, map(normalised, texts)))[:size] for lang, texts in sorted(samples.items())}
        seen, counts = np.unique(np.frombuffer("".join(joined.values()).encode("utf-32-le"), np.uint32), return_counts=True)
        frequent = seen[np.argsort(-counts, kind="stable")][:ALPHABET]
        letters = np.zeros(0x110000, np.uint8)  # 0: a rarer letter
        letters[frequent] = np.arange(DIGITS, DIGITS + len(frequent))
        width = DIGITS + len(frequent)
        tables, starts, lengths, base = [], [], [], 0
        for text in joined.values():
            codes = symbols(text, letters)[:size]
            table = automaton(codes.tolist(), width)
            table = np.where(table > 0, table + base, 0)
            start = np.where(table[1] > 0, table[1], base)
            tables.append(np.where(table > 0, table, ~start))
            starts.append(base)
            lengths.append(len(codes))
            base += len(table)
        table = np.concatenate(tables) if tables else np.zeros((0, width))
        return Parser(list(joined), letters, np.ascontiguousarray(table, np.int32), np.array(starts, np.int64), np.array(lengths, np.int64))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each normalised text by language, and its symbols. Each is a longest match with the language's text.

        Blocks of a text are parsed at once, as if a phrase started with each. Then every parse goes on into the next block
        until it starts a phrase where that block's own parse does, from where both are the same; so counts are those of
        one parse of the whole text.
        """
        codes = [symbols(t, self.letters) for t in texts]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if self.langs:
            blocks = [(k, c[at : at + BLOCK]) for k, c in enumerate(codes) for at in range(0, len(c), BLOCK)]
            carried = None
            for at in range(0, len(blocks), WAVE):
                carried = self._wave(blocks[at : at + WAVE], carried, out)
        return out, np.array([len(c) for c in codes], np.int64)

    def _wave(self, blocks: list[tuple[int, np.ndarray]], carried: tuple[int, np.ndarray] | None, out: np.ndarray) -> tuple[int, np.ndarray]:
        """Add the phrases of successive blocks to out. carried and the result: the last text parsed, and the states after it."""
        texts = np.array([k for k, _ in blocks])
        lengths = np.array([len(b) for _, b in blocks])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        stream = np.zeros((lengths[0], len(blocks)), np.int64)
        for column, k in enumerate(order.tolist()):
            stream[: lengths[column], column] = blocks[k][1]
        place = np.empty(len(blocks), np.int64)
        place[order] = np.arange(len(blocks))
        after = np.full(len(blocks), -1)  # the column of the text's next block
        same = np.flatnonzero(texts[1:] == texts[:-1])
        after[place[same]] = place[same + 1]

        begin = np.tile(self.starts[:, None], (1, len(blocks)))
        if carried is not None and carried[0] == texts[0]:
            begin[:, place[0]] = carried[1]
        width, flat = self.table.shape[1], self.table.ravel()
        active = len(blocks) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))  # blocks with a symbol at each step
        state = begin.copy()
        own = np.zeros((len(active), *state.shape), bool)
        for step, n in enumerate(active.tolist()):
            at = flat[state[:, :n] * width + stream[step, :n]]
            np.less(at, 0, out=own[step, :, :n])
            state[:, :n] = np.maximum(at, ~at)
        count = own.sum(0, dtype=np.int64)
        total, final = count.copy(), state.copy()

        todo = np.sort(after[after >= 0])
        before = np.full(len(blocks), -1)
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        while len(todo):
            added, ended = self._continued(todo, final[:, before[todo]], stream, lengths, own, count, state)
            total[:, todo] = added
            changed = todo[(ended != final[:, todo]).any(0)]
            final[:, todo] = ended
            todo = np.sort(after[changed][after[changed] >= 0])
        np.add.at(out, texts[order], total.T)
        return int(texts[-1]), final[:, place[-1]].copy()

    def _continued(self, columns, state, stream, lengths, own, count, end) -> tuple[np.ndarray, np.ndarray]:
        """Phrases started in the columns' blocks, and the states after them, of parses that enter in state."""
        width, flat = self.table.shape[1], self.table.ravel()
        phrases, final = count[:, columns].copy(), end[:, columns].copy()
        where = np.arange(len(columns))
        state = state.copy()
        apart = np.ones(state.shape, bool)
        step = 0
        while len(where):
            n = int(np.searchsorted(-lengths[columns[where]], -step, "left"))  # columns are in order of length
            gone = where[n:]
            final[:, gone] = np.where(apart[:, n:], state[:, n:], final[:, gone])
            if n < len(where):
                where, state, apart = where[:n], state[:, :n], apart[:, :n]
                continue
            at = flat[state * width + stream[step, columns[where]]]
            fresh, mine = at < 0, own[step][:, columns[where]]
            phrases[:, where] += np.where(apart, fresh.astype(np.int64) - mine, 0)
            state = np.maximum(at, ~at)
            apart &= ~(fresh & mine)
            step += 1
            if step % 8 == 0:
                keep = apart.any(0)
                if not keep.all():
                    where, state, apart = where[keep], state[:, keep], apart[:, keep]
        return phrases, final

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language whose text describes each text in the fewest bits, the first of equal ones, and its share of the evidence.

        Phrases are normalised as in the estimate of cross entropy: each costs the logarithm of the language's training length.
        """
        texts = [normalised(t) for t in texts]
        count, sizes = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = count * np.log2(np.maximum(self.lengths, LEAST_LENGTH))
        best = bits.argmin(1)
        odds = np.exp(-np.minimum(bits - bits.min(1, keepdims=True), 1600) / 32)
        score = np.where(sizes > 0, 1 / odds.sum(1), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)], score


def symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """The symbols of a normalised text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letters[points]
    rare = codes == 0
    if not rare.any():
        return codes
    times = np.where(rare, 7, 1)
    out = np.repeat(codes, times)
    first = (np.cumsum(times) - times)[rare]
    out[first[:, None] + np.arange(7)] = points[rare][:, None] >> np.arange(18, -3, -3, dtype=np.uint32) & 7
    return out


def train(docs: DataFrame) -> Parser:
    """Fit on docs (doc_id, text, lang): for each language, whole texts in the order of a hash until its symbols are full.

    Texts longer than a quarter of a language's symbols come after all others, so that one doesn't stand for a language
    with many. Rows without a text or language teach nothing; without any row every text is `und`. The bound is
    Parser.sample_symbols.

    One aggregate of sizes by language and magnitude of the hash (sixteenths of a power of two) tells how far to go; only
    the rows up to there come to the driver, at most some 5 % more than needed.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("key"))
    langs = known.select("lang").distinct().count()
    size = Parser.sample_symbols(langs)
    late = F.when(F.length("text") > size // 4, F.lit(2000)).otherwise(F.lit(0))
    known = known.withColumn("magnitude", (F.floor(F.log2(F.col("key") + F.lit(1.0)) * 16) + late).cast("int"))
    cuts: dict[str, tuple[int, int]] = {}
    for row in sorted(known.groupBy("lang", "magnitude").agg(F.sum(F.length("text")).alias("n")).collect()):
        reached, _ = cuts.get(row["lang"], (0, 0))
        if reached < 1.25 * size:  # normalised texts are shorter
            cuts[row["lang"]] = (reached + row["n"], row["magnitude"])
    limits = docs.sparkSession.createDataFrame([(lang, m) for lang, (_, m) in cuts.items()], "lang string, most int")
    drawn = known.join(F.broadcast(limits), "lang").where("magnitude <= most").select("lang", (F.col("magnitude") >= 2000).alias("late"), "key", F.substring("text", 1, 2 * size).alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sorted(drawn.collect()):
        samples.setdefault(row["lang"], []).append(row["text"])
    return Parser.fit(samples)


def predict(docs: DataFrame, parser: Parser, into: str = "language") -> DataFrame:
    """docs with a struct column into: lang_pred (`und` without a letter or languages), score (0 to 1). Whole texts are parsed.

    A column into that docs has already is replaced. A null text has no letter; equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            langs, scores = [], []
            for at in range(0, len(text), SLICE_ROWS):
                lang, score = shared.value.predict([t or "" for t in text.iloc[at : at + SLICE_ROWS]])
                langs += lang
                scores.append(score)
            yield pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else np.empty(0)})

    return docs.withColumn(into, F.pandas_udf(run, "lang_pred string, score double")("text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = read(spark, sf_dir, "documents")
    parser = train(docs.where(bucket("doc_id", 3) != 1))
    found = predict(docs.select("doc_id", "text"), parser)
    return found.select(F.col("doc_id").cast("long"), (bucket("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score")
