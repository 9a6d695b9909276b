"""Packing documents into token sequences by fitting length patterns (non-negative least squares)."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import read, record, slices, stored, texts
from ledgerweave.llm.tokens import WORD_BPE, word_tokenizer

SEQUENCE_TOKENS = 2048
SEPARATOR = 0
#: Rows of one length that are ranked together in a task.
CHUNK_ROWS = 65_536
MIN_CHUNKS = 64
#: Candidate patterns, before the fit drops those it doesn't use. A smaller number only leaves more to the residual packing.
MAX_PATTERNS = 60_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut_pieces(docs: DataFrame, limit: int = SEQUENCE_TOKENS, tokenizer: str = WORD_BPE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row of docs (doc_id, text).

    A document is its token ids and then the separator. Only documents longer than limit are cut, into pieces of limit.
    A null or empty text is one piece with the separator alone. Repeated rows are packed as often as they come. Strings of
    special tokens in a text get those tokens' ids, as the tokenizer's file has it. doc_id is of any integer type.
    """

    def cut(batches):
        tok, end = word_tokenizer(tokenizer), np.array([separator], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                ids = tok.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield record(_PIECES, **dict(zip(_PIECES.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _patterns(lengths: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Patterns of one to four lengths that fill a sequence best, as rows padded with 0."""
    below = np.zeros(limit + 1, np.int64)  # the longest length that isn't over the index
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    out = [np.stack([lengths, *[np.zeros_like(lengths)] * 3], 1)]
    rest = below[limit - lengths]
    for back in range(4):  # pairs: the best partner and some shorter ones
        pair = np.stack([lengths, rest], 1)[rest > 0]
        out.append(np.pad(pair, ((0, 0), (0, 2))))
        rest = np.where(rest > 0, below[np.maximum(rest - 1, 0)], 0)
    heavy = lengths[np.argsort(-counts, kind="stable")[: int(MAX_PATTERNS**0.5) * 2]]
    a, b = (x.ravel() for x in np.meshgrid(heavy, heavy, indexing="ij"))
    keep = (a >= b) & (a + b < limit)
    a, b = a[keep], b[keep]
    if len(a) > MAX_PATTERNS:
        step = np.linspace(0, len(a) - 1, MAX_PATTERNS).astype(np.int64)
        a, b = a[step], b[step]
    c = below[limit - a - b]
    out.append(np.stack([a, b, c, below[limit - a - b - c]], 1))
    return np.unique(-np.sort(-np.concatenate(out), axis=1), axis=0)


def _fit(patterns: np.ndarray, target: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: accelerated projected gradient."""
    width = patterns.shape[1]
    flat = patterns.ravel()

    def lengths_of(x):
        got = np.bincount(flat, np.repeat(x, width), len(target))
        got[0] = 0
        return got

    v = np.ones(len(patterns))
    for _ in range(12):
        v = lengths_of(v)[patterns].sum(1)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(steps):
        gradient = (lengths_of(y) - target)[patterns].sum(1)
        new = np.maximum(y - gradient / norm, 0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        x, y, momentum = new, new + (momentum - 1) / after * (new - x), after
    return x


def best_fit(left: Mapping[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count): sequences of equal content move together, so the work doesn't grow with the counts."""
    by_space: dict[int, dict[tuple[int, ...], int]] = {}
    mask = 0
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = mask >> length
            if fits:
                space = length + (fits & -fits).bit_length() - 1
                content, there = by_space[space].popitem()
                used = min(n, there)
                if there > used:
                    by_space[space][content] = there - used
                if not by_space[space]:
                    mask &= ~(1 << space)
                put = [(space - length, (*content, length), used)]
                n -= used
            else:
                each = limit // length
                full, rest = divmod(n, each)
                put = [(limit - each * length, (length,) * each, full), (limit - rest * length, (length,) * rest, int(rest > 0))]
                n = 0
            for space, content, times in put:
                if times:
                    kinds = by_space.setdefault(space, {})
                    kinds[content] = kinds.get(content, 0) + times
                    mask |= 1 << space
    return [(content, times) for kinds in by_space.values() for content, times in kinds.items()]


def plan(histogram: Mapping[int, int], limit: int = SEQUENCE_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the sequences that hold a histogram of lengths (1 to limit).

    Patterns are fitted to the histogram, their repeats rounded to what is there, and the rest goes to best fit.
    """
    target = np.zeros(limit + 1)
    for length, n in histogram.items():
        target[length] = n
    left = target.astype(np.int64)
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        chosen.append(((limit,), int(left[limit])))
        left[limit] = 0
    present = np.flatnonzero(left)
    if len(present) > 1:
        patterns = _patterns(present, left[present], limit)
        patterns = patterns[patterns.sum(1) >= limit - max(1, limit // 256)]  # what fills less waits for the residual packing
        goal = left.astype(float)
        for keep in (4 * limit, limit, 0):
            if not len(patterns):
                break
            x = _fit(patterns, goal)
            order = np.argsort(-x, kind="stable")
            order = order[x[order] > 1e-6]
            patterns, x = patterns[order[: keep or None]], x[order[: keep or None]]
        if len(patterns):
            for pattern, times in zip(patterns.tolist(), np.rint(x).astype(np.int64).tolist(), strict=True):
                content = tuple(v for v in pattern if v)
                times = min([times, *(int(left[v]) // content.count(v) for v in set(content))])
                if times > 0:
                    chosen.append((content, times))
                    for v in content:
                        left[v] -= times
    return chosen + best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, limit)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank) keys with the first sequence id and the offset of each slot."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for content, times in planned:
        offset = 0
        for length in content:
            rank = used.get(length, 0)
            rows.append((length << 44 | rank, rank, first, offset))
            used[length] = rank + times
            offset += length
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table[:, k].copy() for k in range(4))


def pack(docs: DataFrame, limit: int = SEQUENCE_TOKENS, tokenizer: str = WORD_BPE, separator: int = SEPARATOR) -> DataFrame:
    """Pack every row of docs (doc_id, text) into sequences of at most limit tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences are gapless from
    offset 0; ids are dense from 0. An empty table gives no rows; null texts are documents of one token; null ids stay null.

    Only the length histogram (at most limit rows) reaches the driver. Pieces get their rank within their length from a
    window over (length, chunk), so a length that many pieces share is dealt over many tasks.
    """
    pieces = stored(cut_pieces(docs, limit, tokenizer, separator))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    total = sum(histogram.values())
    chunks = max(MIN_CHUNKS, total // CHUNK_ROWS)
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, limit)))

    keyed = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    counts = keyed.groupBy("length", "chunk").count()
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def place(batches):
        keys, ranks, firsts, offsets = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            kept = {n: batch.column(n) for n in _PIECES.names}
            yield record(_PLACED, **kept, sequence_id=firsts[at] + rank - ranks[at], offset=offsets[at])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(read(spark, sf_dir, "documents"))
