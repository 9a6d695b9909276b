"""Benchmark passages in documents: winnowed k-gram fingerprints, joined and extended to whole shared spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import columns_of, numbered, read, record, slices, stored, unused, utf8

WINDOW_WORDS = 10
GRAM_WORDS = 6
#: Words (and 32 times as many bytes) of a benchmark that is indexed and broadcast. A larger one is joined in Spark.
BLOCK_WORDS = 2_000_000
WORD_BYTES = 32
#: Parts that a fingerprint or window of a joined benchmark is dealt over, as one may stand in a third of all documents.
SALTS = 16

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered; on UTF-8 bytes these are digits, a-z and all beyond ASCII."""
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k word ids; the largest value where the run holds 0, a word that the benchmark lacks."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    value = _mixed(ids.astype(np.uint64))
    n, out, bad = len(ids) - k + 1, np.zeros(len(ids) - k + 1, np.uint64), np.zeros(len(ids) - k + 1, bool)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + value[j : j + n]
        bad |= ids[j : j + n] == 0
    out = _mixed(out)
    out[out == _NONE] -= np.uint64(1)
    out[bad] = _NONE
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hashes of each window of so many, ties included; all positions if there are fewer."""
    if len(hashes) <= window or window == 1:
        return np.arange(len(hashes))
    n = len(hashes) - window + 1
    least = hashes[:n].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j : j + n], out=least)
    picked = np.zeros(len(hashes), bool)
    for j in range(window):
        picked[j : j + n] |= hashes[j : j + n] == least
    return np.flatnonzero(picked)


class Index:
    """A block of benchmark items: sorted fingerprints, and the distinct windows with the items that hold each.

    Windows are runs of window words, and the whole of an item of fewer, by their length. Of long items' windows only the
    winnowed gram-grams are searched for, and of short ones the one gram of their own length.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW_WORDS, gram: int = GRAM_WORDS):
        self.window, self.gram = window, gram
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64) for _, words in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, words in enumerate(ids):
            by_size.setdefault(min(len(words), window), []).append((k, words))
        self.tables = {n: _Windows(n, gram if n == window else n, held) for n, held in by_size.items()}

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: the length, the places in ids where a window of the block starts, and its number there."""
        for n, table in self.tables.items():
            at, kind = table.find(ids)
            if len(at):
                yield n, at, kind

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """start, end and item of each stretch of words that windows of the item cover, by item and start; windows that touch are one."""
        found: list[tuple[int, int, int]] = []
        for n, at, kind in self.hits(ids):
            first, last = self.tables[n].holders(kind)
            times = last - first
            start = np.repeat(at, times)
            item = self.tables[n].items[np.repeat(last - np.cumsum(times), times) + np.arange(times.sum())]
            order = np.lexsort((start, item))
            start, item = start[order], item[order]
            new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (start[1:] > start[:-1] + n)])
            ends = start[np.r_[new[1:] - 1, len(start) - 1]] + n
            found += zip(start[new].tolist(), ends.tolist(), item[new].tolist(), strict=True)
        return found


class _Windows:
    """The distinct windows of one length: a representative place of each, its items, and the fingerprints to meet them by."""

    def __init__(self, size: int, gram: int, held: list[tuple[int, np.ndarray]]):
        self.size, self.gram = size, gram
        lengths = np.array([len(words) for _, words in held])
        # items one after the other, 0 between them, so that no window crosses
        self.words = np.concatenate([np.r_[words, 0] for _, words in held])
        item = np.repeat(np.array([k for k, _ in held], np.int64), lengths + 1)
        marks = [winnow(gram_hashes(words, gram), size - gram + 1) + s for (_, words), s in zip(held, np.cumsum(lengths + 1) - lengths - 1, strict=True)]
        self.prints = np.unique(gram_hashes(self.words, gram)[np.concatenate(marks)])
        self.salt = 0
        while True:  # until equal hashes mean equal windows here; then one comparison with the representative is exact
            hashes = self._hashes(self.words)
            place = np.flatnonzero(hashes != _NONE)
            keys, first, kind = np.unique(hashes[place], return_index=True, return_inverse=True)
            if all((self.words[place + j] == self.words[place[first[kind]] + j]).all() for j in range(size)):
                break
            self.salt += 1
        self.keys, self.place = keys, place[first]
        pairs = np.unique(np.stack([kind, item[place]], 1), axis=0)
        self.first, self.items = np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)), pairs[:, 1]

    def _hashes(self, ids: np.ndarray) -> np.ndarray:
        return gram_hashes(np.where(ids > 0, ids + (self.salt << 40), 0), self.size)

    def holders(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[kind], self.first[kind + 1]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids where a window starts, in order, and which it is.

        A place is looked at if a fingerprint of ids that lies in its window is one of the block's. Each is compared word by
        word with one representative, so repetitive texts cost no more than others.
        """
        grams = gram_hashes(ids, self.gram)
        at = winnow(grams, self.size - self.gram + 1)
        at = at[grams[at] != _NONE]
        near = np.searchsorted(self.prints, grams[at])
        at = at[self.prints[np.minimum(near, len(self.prints) - 1)] == grams[at]]
        if not len(at):
            return at, at
        starts = np.unique((at[:, None] - np.arange(self.size - self.gram + 1)).ravel())
        starts = starts[(starts >= 0) & (starts <= len(ids) - self.size)]
        hashes = np.full(len(starts), _NONE)
        if len(starts):
            words = ids[starts[:, None] + np.arange(self.size)]
            hashes = self._hashes(words.ravel())[:: self.size][: len(starts)] if self.size > 1 else self._hashes(words.ravel())
        kind = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        same = (hashes != _NONE) & (self.keys[kind] == hashes)
        starts, kind = starts[same], kind[same]
        for j in range(self.size):
            same = ids[starts + j] == self.words[self.place[kind] + j]
            starts, kind = starts[same], kind[same]
        return starts, kind


_FOUND = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.octet_length("text") > 0)


def _index(benchmark: DataFrame, window: int, gram: int, block_words: int) -> Index | None:
    """The index of a benchmark of at most block_words words and WORD_BYTES times as many bytes; None for a larger one, of which nothing is fetched."""

    def count(batches):
        for batch in slices(batches):
            yield pa.record_batch({"n": pa.array([len(words_of(t)) for t in utf8(batch, "text")], pa.int64())})

    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))).alias("n")).first().n or 0
    words = items.mapInArrow(count, "n long").agg(F.sum("n").alias("n")).first().n or 0
    if words > block_words or size > WORD_BYTES * block_words:
        return None
    held = ((row.item, words_of(row.text.encode())) for row in items.toLocalIterator())
    return Index([(item, words) for item, words in held if words], window, gram)


def _marks(words: list[bytes], size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed grams by which windows of so many words are met."""
    k = min(gram, size)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.uint64)
    at = winnow(hashes, size - k + 1)
    return at, hashes[at].view(np.int64)


def _join_search(keyed: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """As _search for a benchmark of any size: its fingerprints and windows are made in tasks, and both joins are salted equi-joins.

    Fingerprints of documents that the benchmark has say which windows of the text are compared; these are joined by their
    words, so the result is exact. A document's own hits meet in one row, as the result has them.
    """

    def windows(batches):
        schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("words", pa.string()), ("prints", pa.list_(pa.int64()))])
        for batch in slices(batches):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch, "text"), strict=True):
                words = words_of(text)
                n = min(len(words), window)
                if n:
                    prints = np.unique(_marks(words, n, gram if n == window else n)[1]).tolist()
                    grams = dict.fromkeys(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
                    out += [(item, n, g.decode(), prints if not k else []) for k, g in enumerate(grams)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield record(schema, **dict(zip(schema.names, map(list, columns), strict=True)))

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    made = stored(_items(benchmark).mapInArrow(windows, "item string, n int, words string, prints array<long>"))
    sizes = sorted(r.n for r in made.select("n").distinct().collect())
    prints = made.select("n", F.explode("prints").alias("print")).distinct().select("*", salts)

    def fingerprints(batches):
        schema = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("print", pa.int64()), ("salt", pa.int32())])
        for batch in slices(batches):
            for row, text in zip(batch.column("row").to_pylist(), utf8(batch, "text"), strict=True):
                words = words_of(text)
                for n in sizes:
                    if len(words) >= n:
                        at, marks = _marks(words, n, gram if n == window else n)
                        m = len(at)
                        yield record(schema, row=pa.array([row] * m, pa.int64()), n=pa.array([n] * m, pa.int32()), at=pa.array(at.astype(np.int32)), print=pa.array(marks), salt=pa.array([row % SALTS] * m, pa.int32()))

    def around(batches):
        schema = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("words", pa.string()), ("salt", pa.int32())])
        for batch in slices(batches):
            for row, text, met in zip(batch.column("row").to_pylist(), utf8(batch, "text"), batch.column("met").to_pylist(), strict=True):
                words, starts = words_of(text), set()
                for m in met:
                    first = m["at"] - (m["n"] - (gram if m["n"] == window else m["n"]))
                    starts.update((m["n"], s) for s in range(max(first, 0), min(m["at"], len(words) - m["n"]) + 1))
                picked = sorted(starts)
                texts = [b" ".join(words[s : s + n]).decode() for n, s in picked]
                yield record(schema, row=[row] * len(picked), n=[n for n, _ in picked], start=[s for _, s in picked], words=texts, salt=[row % SALTS] * len(picked))

    def merge(batches):
        schema = pa.schema([_FOUND.field("row"), ("doc_id", pa.int64()), *list(_FOUND)[1:]])
        for batch in slices(batches):
            starts, ends, items = [], [], []
            for hits in batch.column("hits").to_pylist():
                spans: list[list] = []
                for h in sorted(hits or [], key=lambda h: (h["item"] is not None, h["item"] or "", h["start"])):
                    if spans and spans[-1][2] == h["item"] and h["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], h["start"] + h["n"])
                    else:
                        spans.append([h["start"], h["start"] + h["n"], h["item"]])
                for column, k in ((starts, 0), (ends, 1), (items, 2)):
                    column.append([s[k] for s in spans])
            counts = [len(words_of(t)) for t in utf8(batch, "text")]
            yield record(schema, row=batch.column("row"), doc_id=batch.column("doc_id"), n_words=counts, starts=starts, ends=ends, items=items)

    keyed = stored(keyed)
    met = keyed.select("row", "text").mapInArrow(fingerprints, "row long, n int, at int, print long, salt int").join(prints, ["n", "print", "salt"], "left_semi")
    met = met.groupBy("row").agg(F.collect_list(F.struct("n", "at")).alias("met"))
    near = keyed.select("row", "text").join(met, "row").mapInArrow(around, "row long, n int, start int, words string, salt int")
    hits = near.join(made.select("item", "n", "words").distinct().select("*", salts), ["n", "words", "salt"])
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("item", "start", "n")).alias("hits"))
    return keyed.join(hits, "row", "left").select("row", "doc_id", "text", "hits").mapInArrow(merge, "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends, items for each row of docs (doc_id, text): spans of words shared with benchmark items.

    Winnowing keeps the least of each window - gram + 1 successive gram hashes, so every shared run of window words has a
    common fingerprint; the windows round it are then compared word by word, so equal hashes of unequal words give
    nothing. A span is a stretch that windows of one item cover. A shorter item is one window of all its words. Null texts
    have no words; items without words or with a null id name no item (the latter still mark words). Repeated items are
    one item, repeated rows of docs come as often as they are there. doc_id is of any integer type, item_id of any type
    with a text form; items holds that text.

    A benchmark of at most block_words words is indexed and broadcast; a larger one is joined in Spark, with the same result.
    """
    keyed = numbered(docs.select(F.col("doc_id").cast("long"), "text"), ("doc_id", "text"))
    return _found(keyed, benchmark, window, gram, block_words).drop("row")


def _found(keyed: DataFrame, benchmark: DataFrame, window: int, gram: int, block_words: int) -> DataFrame:
    index = _index(benchmark, window, gram, block_words)
    if index is None:
        return _join_search(keyed, benchmark, window, gram)
    return _search(keyed, keyed.sparkSession.sparkContext.broadcast(index))


def _search(keyed: DataFrame, index) -> DataFrame:
    schema = pa.schema([_FOUND.field("row"), ("doc_id", pa.int64()), *list(_FOUND)[1:]])

    def run(batches):
        known = index.value
        lookup = known.vocabulary.get
        for batch in slices(batches):
            words = [words_of(t) for t in utf8(batch, "text")]
            counts = np.array([len(w) for w in words], np.int64)
            # one array for all texts, 0 between them: runs never cross from one text to the next
            ids = np.array([lookup(w, 0) for w in chain.from_iterable((*ws, b"") for ws in words)], np.int64)
            first = np.cumsum(counts + 1) - counts - 1
            starts, ends, items = ([[] for _ in words] for _ in range(3))
            for s, e, item in known.spans(ids):
                k = int(np.searchsorted(first, s, "right")) - 1
                starts[k].append(s - int(first[k]))
                ends[k].append(e - int(first[k]))
                items[k].append(known.names[item])
            yield record(schema, row=batch.column("row"), doc_id=batch.column("doc_id"), n_words=counts, starts=starts, ends=ends, items=items)

    return keyed.mapInArrow(run, "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def digest(found: DataFrame) -> DataFrame:
    """n_hit (words inside any span), n_items, items_sha256 and contaminated for each row of find_passages."""

    def run(batches):
        for batch in batches:
            hits, n_items, shas = [], [], []
            for starts, ends, items in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
                n, upto = 0, 0
                for s, e in sorted(zip(starts, ends, strict=True)):
                    n += max(0, e - max(s, upto))
                    upto = max(upto, e)
                names = sorted({i for i in items if i is not None})
                hits.append(n)
                n_items.append(len(names))
                shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield record(_DIGEST, doc_id=batch.column("doc_id"), n_words=batch.column("n_words"), n_hit=hits, n_items=n_items, items_sha256=shas, contaminated=[h > 0 for h in hits])

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of any benchmark item; columns are those of docs, whatever their names and ids.

    Null texts stay. Rows are filtered where they are, without a shuffle, by a benchmark of at most block_words words. By a
    larger one, distinct texts are searched, and docs joined with those that hold a window, by their SHA-256.
    """
    index = _index(benchmark, window, gram, block_words)
    if index is not None:
        return docs.where(_clean(docs.sparkSession.sparkContext.broadcast(index))("text"))
    key = unused(docs.columns, "text_key")
    texts = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias(key), "text").where("text is not null").groupBy(key).agg(F.any_value("text").alias("text"))
    texts = stored(texts.select(F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("doc_id"), "text", key))
    hit = _join_search(texts.select("row", "doc_id", "text"), benchmark, window, gram).where(F.size("starts") > 0).select("row")
    gone = texts.join(hit, "row", "left_semi").select(key)
    return docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256)).join(gone, key, "left_anti").select(*columns_of(docs))


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = index.value
        lookup = known.vocabulary.get
        for batch in batches:
            out = []
            for text in batch:
                ids = np.array([lookup(w, 0) for w in words_of((text or "").encode())], np.int64)
                out.append(next(known.hits(ids), None) is None)
            yield pd.Series(out, dtype=bool)

    return clean


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return digest(find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select distinct item_id, {_SQL_WORDS} as w from benchmark),
bw as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from bw),
sizes as (select distinct n from windows),
dw as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
hits as (select doc_id, i, dw.n, item_id from dw join windows on windows.n = dw.n and windows.g = array_to_string(w[i:i + dw.n - 1], ' ')),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, sha256(string_agg(name, ',' order by name)) as sha from (select distinct doc_id, item_id::varchar as name from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join named using (doc_id)
"""
