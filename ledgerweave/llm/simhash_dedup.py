"""SimHash near-duplicates by tiled exact comparison of distinct fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import read, record, slices, stored, text_key, unused, utf8

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints in a tile. What moves for each comparison falls with it.
TILE = 16_384
#: Near copies: 64-bit words of a wide fingerprint, words of a shingle, and the least similarity of their shingle sets.
WIDE_WORDS = 8
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of two wide fingerprints, and of their first words, that still link. Sets of Jaccard similarity 0.8 differ
#: in about 77 of 512 bits; the README has what these limits catch.
WIDE_RADIUS = 87
FIRST_RADIUS = 18
WIDE_TILE = 8192
#: Below so many pairs, two tiles are compared without looking at their finer population counts.
PLAIN_PAIRS = 8_000_000
#: Pairs that numpy compares at once, so that they stay in the CPU's cache.
BLOCK_PAIRS = 65_536


def shingle_hashes(text: bytes, shingle_words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, in order; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # bytes: lowers A-Z and splits on 0x20 and 0x09-0x0D only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """A row of 64-bit words whose bits are set in over half of the rows of hashes; zero without rows."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 16_320):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 16_320], "<u8").view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 rows fit a byte
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), 1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += np.add.reduce(bits[whole:], 0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    return int(_majority(shingle_hashes(text, shingle_words, seed)[:, None])[0])


def wide_fingerprint_of(text: bytes, shingle_words: int = WIDE_SHINGLE, words: int = WIDE_WORDS) -> tuple[bytes, int]:
    """The majority bits of the text's distinct shingles, each hashed to so many words, and the number of those shingles."""
    first = np.unique(shingle_hashes(text, shingle_words))
    x = first[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x[:, 1:] = _mixed(x[:, 1:])
    return _majority(x).tobytes(), len(first)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """The columns of keep, as longs, and fingerprint (its 64 bits as a long) for each row of docs; null and wordless texts have 0.

    Columns of keep are of integer types. Repeated rows come as often as they are there; an empty table gives no rows.
    """
    schema = pa.schema([(n, pa.int64()) for n in (*keep, "fingerprint")])

    def run(batches):
        for batch in slices(batches):
            bits = np.array([fingerprint_of(t, shingle_words, seed) for t in utf8(batch, "__text")], np.uint64)
            yield record(schema, **{n: batch.column(n) for n in keep}, fingerprint=bits.view(np.int64))

    kept = docs.select(*(F.col(n).cast("long") for n in keep), F.col("text").alias("__text"))
    return kept.mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def _quarter(k: int) -> Column:
    """Population count of the k-th 16 bits of the fingerprint, from the top."""
    return F.bit_count(F.shiftrightunsigned("fingerprint", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)))


def _join_components(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the components of u[i] and v[i], for all i; parent[x] is the least member of x's component."""
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _close(a: np.ndarray, b: np.ndarray, radius: int, put) -> None:
    rows = max(1, BLOCK_PAIRS // max(1, len(b)))
    for at in range(0, len(a), rows):
        hits = np.flatnonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        if len(hits):
            put(at + hits // len(b), hits % len(b))


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or of a tile with itself): no link's connection is lost.

    Large tiles are compared by groups of equal population counts of their third and fourth 16 bits; groups whose
    counts differ beyond the radius are skipped, as no pair between them can be within it.
    """
    a, b = np.sort(a), np.sort(b)
    parent = np.arange(len(a) + len(b))
    if len(a) * len(b) <= PLAIN_PAIRS:
        _close(a, b, radius, lambda i, j: _join_components(parent, i, j + len(a)))
    else:
        (a3, a4), (b3, b4) = ((np.bitwise_count(x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), np.bitwise_count(x & np.uint64(0xFFFF)).astype(np.int64)) for x in (a, b))
        ka, kb = a3 * 32 + a4, b3 * 32 + b4
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        a, b, ka, kb = a[oa], b[ob], ka[oa], kb[ob]
        for key in np.unique(ka).tolist():
            s, e = np.searchsorted(ka, [key, key + 1])
            for d in range(-radius, radius + 1):
                third, fourth, w = key // 32 + d, key % 32, radius - abs(d)
                if third < 0:
                    continue
                x, y = np.searchsorted(kb, [third * 32 + max(0, fourth - w), third * 32 + fourth + w + 1])
                if y > x:
                    _close(a[s:e], b[x:y], radius, lambda i, j, s=s, x=x: _join_components(parent, i + s, j + x + len(a)))
    both = np.concatenate([a, b])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    u, v = both[moved], both[parent[moved]]
    apart = u != v
    return u[apart], v[apart]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """u, v: links between distinct fingerprints that connect all that are within radius of each other.

    A tile holds fingerprints with the same population counts of the first and of the second 16 bits. Only tile pairs whose
    counts differ by the radius at most are compared. A large cell is dealt over several tiles, so no task gets more
    than two tiles at once. distinct has a unique column fingerprint.
    """
    spark = distinct.sparkSession
    celled = distinct.select("fingerprint", (_quarter(0) * 17 + _quarter(1)).alias("cell"))
    counts = celled.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("subs"))  # 289 rows at most
    tiles = celled.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("fingerprint"), F.col("subs")).cast("int").alias("sub"))
    tiles = stored(tiles.agg(F.collect_list("fingerprint").alias("prints")))
    near = [(x * 17 + y, i * 17 + j) for x in range(17) for y in range(17) for i in range(17) for j in range(17) if abs(x - i) + abs(y - j) <= radius]
    near = spark.createDataFrame(near, "cell int, other int")
    ids = tiles.select("cell", "sub")
    pairs = ids.join(F.broadcast(near), "cell").join(F.broadcast(counts.select(F.col("cell").alias("other"), "subs")), "other")
    pairs = pairs.select("cell", "sub", "other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("osub"))
    pairs = pairs.where("(other, osub) >= (cell, sub)")
    both = pairs.join(tiles, ["cell", "sub"]).withColumnRenamed("prints", "a")
    both = both.join(tiles.select(F.col("cell").alias("other"), F.col("sub").alias("osub"), F.col("prints").alias("b")), ["other", "osub"])
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            for k in range(batch.num_rows):
                u, v = tile_links(*(x[k].values.to_numpy().view(np.uint64) for x in (a, b)), radius)
                if len(u):
                    yield record(schema, u=u.view(np.int64), v=v.view(np.int64))

    return both.select("a", "b").mapInArrow(compare, "u long, v long")


def wide_tile_links(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], radius: int, first_radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of a spanning forest of the links between two tiles of (prints, sizes); places in b follow those in a.

    Prints link if they differ in radius bits at most and in first_radius of the first word, and the smaller size is at
    least similarity times the larger, as it is for sets of that similarity.
    """
    (pa_, sa), (pb, sb) = a, b
    parent = np.arange(len(pa_) + len(pb))
    oa, ob = np.argsort(sa, kind="stable"), np.argsort(sb, kind="stable")
    first_a, first_b, sizes = np.ascontiguousarray(pa_[oa, 0]), np.ascontiguousarray(pb[ob, 0]), sb[ob]
    rows = 16
    for at in range(0, len(oa), rows):
        own = oa[at : at + rows]
        low = int(np.searchsorted(sizes, np.floor(sa[own[0]] * similarity - 1e-6), "left"))
        high = int(np.searchsorted(sizes, np.ceil(sa[own[-1]] / similarity + 1e-6), "right"))
        for start in range(low, high, BLOCK_PAIRS // rows):
            stop = min(high, start + BLOCK_PAIRS // rows)
            hits = np.flatnonzero(np.bitwise_count(first_a[at : at + rows, None] ^ first_b[None, start:stop]) <= first_radius)
            if not len(hits):
                continue
            i, j = own[hits // (stop - start)], ob[start + hits % (stop - start)]
            apart = parent[i] != parent[j + len(pa_)]  # linked by others already
            i, j = i[apart], j[apart]
            near = np.minimum(sa[i], sb[j]) >= similarity * np.maximum(sa[i], sb[j]) - 1e-9
            i, j = i[near], j[near]
            near = np.bitwise_count(pa_[i] ^ pb[j]).sum(1, dtype=np.int64) <= radius
            if near.any():
                _join_components(parent, i[near], j[near] + len(pa_))
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return moved, parent[moved]


def wide_links(distinct: DataFrame, radius: int = WIDE_RADIUS, first_radius: int = FIRST_RADIUS, similarity: float = SIMILARITY, tile: int = WIDE_TILE) -> DataFrame:
    """u, v: links between the nodes of distinct (node, print, size) that connect all that wide_tile_links links.

    Tiles hold prints of sizes within a factor of 1 / similarity; only tiles whose sizes can be that near, and whose
    population counts come within the radius of each other, are compared. A band of many sizes is dealt over several tiles,
    so no task gets more than two tiles at once.
    """
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(float(np.log(1.01 / similarity)))).cast("int")
    banded = distinct.select("node", "print", "size", band.alias("band"))
    counts = banded.groupBy("band").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("subs"))  # some hundred rows at most
    tiles = banded.join(F.broadcast(counts), "band").groupBy("band", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int").alias("sub"))
    tiles = stored(tiles.agg(F.collect_list(F.struct("node", "print", "size")).alias("held")))
    ids = tiles.select("band", "sub")
    others = counts.select(F.col("band").alias("other"), "subs")
    pairs = ids.join(F.broadcast(others), F.col("other").between(F.col("band"), F.col("band") + 1))
    pairs = pairs.select("band", "sub", "other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("osub")).where("other > band or osub >= sub")
    both = pairs.join(tiles, ["band", "sub"]).withColumnRenamed("held", "a")
    both = both.join(tiles.select(F.col("band").alias("other"), F.col("sub").alias("osub"), F.col("held").alias("b")), ["other", "osub"])
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in ("a", "b")]
                nodes = [x.field("node").to_numpy() for x in sides]
                prints = [np.frombuffer(b"".join(x.field("print").to_pylist()), "<u8").reshape(len(x), -1) for x in sides]
                ones = [np.bitwise_count(p).sum(1, dtype=np.int64) for p in prints]
                if max(ones[0].min() - ones[1].max(), ones[1].min() - ones[0].max()) > radius:
                    continue
                u, v = wide_tile_links(*((p, x.field("size").to_numpy()) for p, x in zip(prints, sides, strict=True)), radius, first_radius, similarity)
                both_nodes = np.concatenate(nodes)
                apart = both_nodes[u] != both_nodes[v]
                if apart.any():
                    yield record(schema, u=both_nodes[u[apart]], v=both_nodes[v[apart]])

    return both.select("a", "b").mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v): root is the least node reachable.

    Alternates large and small stars. Minima are map-side aggregates joined back, so that a node with very many edges
    isn't gathered in one task.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0] or state == seen:
            break
        seen = state
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (fingerprint, doc_id and others) with root, the least fingerprint reachable, and component_id, the least doc_id.

    Exact copies share a fingerprint and cost one comparison. Null ids are never the least unless all are null.
    """
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct, radius)).select(F.col("node").alias("fingerprint"), "root")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = stored(rooted)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    key = unused(docs.columns, "text_key")
    return docs.withColumn(key, text_key("text")), key


def _firsts(grouped: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose id and key are those of the first of each group (root) of grouped (doc_id, key, root, times)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"), F.col("times").alias("times"))
    first = grouped.groupBy("root").agg(F.min(order).alias("first"))
    own_id, own_key, times = (unused(docs.columns, n) for n in ("first_id", "first_key", "first_times"))
    first = stored(first.select(F.col("first.id").alias(own_id), F.col("first.key").alias(own_key), F.col("first.times").alias(times)))
    kept = docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))).drop(own_id, own_key)
    once = kept.where(F.col(times) == 1)
    again = kept.where(F.col(times) > 1).dropDuplicates(["doc_id", key])
    return once.unionByName(again).drop(times, key)


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of fingerprints within the radius: the least doc_id, and of rows with that id the least text hash.

    Rows that agree in id and text are one document; one of them stays. Columns are those of docs, whatever their names. A
    null id stays only in a group without other ids. doc_id is of any integer type. An empty table stays empty.
    """
    keyed, key = _keyed(docs)
    prints = stored(fingerprints(keyed.select("doc_id", F.col(key).alias("key"), "text"), ("doc_id", "key")))
    times = prints.groupBy("doc_id", "key", "fingerprint").agg(F.count("*").alias("times"))
    return _firsts(near_duplicates(times, radius), keyed, key)


def wide_fingerprints(docs: DataFrame, shingle_words: int = WIDE_SHINGLE, words: int = WIDE_WORDS) -> DataFrame:
    """doc_id, key, print (binary) and size for each row of docs (doc_id, key, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("print", pa.binary()), ("size", pa.int32())])

    def run(batches):
        for batch in slices(batches):
            found = [wide_fingerprint_of(t, shingle_words, words) for t in utf8(batch, "text")]
            yield record(schema, doc_id=batch.column("doc_id"), key=batch.column("key"), print=[p for p, _ in found], size=[n for _, n in found])

    return docs.select(F.col("doc_id").cast("long"), "key", "text").mapInArrow(run, "doc_id long, key long, print binary, size int")


def deduplicate_near_copies(docs: DataFrame, radius: int = WIDE_RADIUS, first_radius: int = FIRST_RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: five-word shingles, a similarity of 0.8 or more by wide fingerprints.

    Which row stays, and what becomes of nulls, repeated rows, ids and names of columns, is as in deduplicate. Texts
    without words are copies of each other.
    """
    keyed, key = _keyed(docs)
    prints = stored(wide_fingerprints(keyed.select("doc_id", F.col(key).alias("key"), "text")))
    distinct = stored(prints.select("print", "size").distinct().withColumn("node", F.monotonically_increasing_id()))
    roots = components(wide_links(distinct, radius, first_radius, similarity))
    rooted = distinct.join(roots, "node", "left").select("print", "size", F.coalesce("root", "node").alias("root"))
    times = prints.groupBy("doc_id", "key", "print", "size").agg(F.count("*").alias("times"))
    return _firsts(times.join(rooted, ["print", "size"]), keyed, key)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = stored(fingerprints(read(spark, sf_dir, "documents")))
    found = near_duplicates(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
