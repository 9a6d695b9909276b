"""Quality rules on documents, and line frequencies across the documents of a host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import columns_of, read, record, slices, stored, unused, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
#: A line is boilerplate where more distinct documents of its host hold it than this, however large the host.
LINE_DOCUMENTS = 20
#: Boilerplate lines that are broadcast at most; more are joined by line and one of SALTS parts of the rows.
BROADCAST_LINES = 500_000
SALTS = 32
#: A document is depleted where its other lines hold less than this percentage of its words.
LEAST_LEFT_PERCENT = 30


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside any window of so many words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key = ids[:n]
    for k in range(1, window):  # pairs, then triples: ranks stay below the text's length, so products fit 64 bits
        key = key * len(seen) + ids[k : k + n]
        _, key, counts = np.unique(key, return_inverse=True, return_counts=True)
    often = counts[key] > 1
    hit = np.zeros(len(words), bool)
    for k in range(window):
        hit[k : k + n] |= often
    return int(hit.sum())


def normalised(line: bytes) -> bytes:
    """A line as it is compared: lower case, one space for any white space, none at its ends."""
    return b" ".join(line.decode("utf-8", "replace").lower().encode().split())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def line_hashes(text: bytes) -> tuple[int, dict[int, int]]:
    """A hash of all normalised lines in order, and the words of each distinct one, by hash, counting every time that it stands in the text.

    The first stands for the document when distinct documents are counted: only copies share it, whatever lines they have.
    """
    out: dict[int, int] = {}
    lines = [x for x in map(normalised, text.split(b"\n")) if x]
    for line in lines:
        key = xxhash.xxh64_intdigest(line) - (1 << 63)
        out[key] = out.get(key, 0) + line.count(b" ") + 1
    return xxhash.xxh64_intdigest(b"\n".join(lines)) - (1 << 63), out


_MEASURED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("hash", pa.int64()), ("document", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))]
)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each row of docs (doc_id, text, host): row, doc_id, hash, the base counts, base_failed, kept, and removed.

    base_failed: under 50 words, or over half of them inside 3-word windows that the text repeats. removed: hashes of the
    text's lines that more than 20 distinct documents of the host hold; texts with the same normalised lines are one. kept:
    neither base_failed nor depleted, that is with under 30 % of its words in other lines. A null text has no words and
    fails; null hosts are one host. hash is of the text and host; rows that agree in doc_id and hash have the same verdict.
    doc_id is of any integer type; an empty table gives no rows. Lines are counted by distinct (host, line, document) and
    then (host, line), both with partial aggregates, so one line in a third of all rows is no hot task.
    """

    def run(batches):
        for batch in slices(batches):
            data = utf8(batch, "text")
            counted = list(zip(*map(measure, data), strict=True)) or [[]] * 5
            found = [line_hashes(text) for text in data]
            lines = [[{"line": h, "words": n} for h, n in held.items()] for _, held in found]
            base = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, counted), strict=True))
            yield record(_MEASURED, row=batch.column("row"), doc_id=batch.column("doc_id"), host=batch.column("host"), hash=batch.column("hash"), document=[d for d, _ in found], lines=lines, **base)

    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col(host).cast("string")).alias("hash"), "text",
    )
    counts = ", ".join(f"{n} long" for n in _MEASURED.names[5:10])
    measured = stored(own.mapInArrow(run, f"row long, doc_id long, host string, hash long, document long, {counts}, lines array<struct<line: long, words: int>>"))

    lines = measured.select("row", "host", "document", F.inline("lines"))
    held = lines.groupBy("host", "line", "document").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.sum("one").alias("documents"))
    frequent = stored(held.where(F.col("documents") > LINE_DOCUMENTS).select("host", "line"))
    if frequent.count() <= BROADCAST_LINES:
        gone = lines.join(F.broadcast(frequent), ["host", "line"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        gone = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    removed = gone.groupBy("row").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("removed"))
    judged = measured.drop("lines", "host", "document").join(removed, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return judged.select(
        "row", "doc_id", "hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left * 100 >= F.col("n_words") * LEAST_LEFT_PERCENT)).alias("kept"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
    )


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept rows of docs, without their boilerplate lines; a column n_chars follows the text. Columns are those of docs, whatever their names."""
    verdicts = judge(docs, host).where("kept").groupBy("doc_id", "hash").agg(F.first("removed").alias("removed"))
    own_id, own_hash, removed, key = (unused(docs.columns, n) for n in ("verdict_id", "verdict_hash", "removed", "text_key"))
    verdicts = verdicts.select(F.col("doc_id").alias(own_id), F.col("hash").alias(own_hash), F.col("removed").alias(removed))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")), F.col(host).cast("string")))
    kept = keyed.join(verdicts, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash)))

    @F.pandas_udf("string")
    def without(text, removed):
        out = []
        for t, gone in zip(text, removed, strict=True):
            if t and len(gone):
                hashes = set(gone.tolist())
                t = "\n".join(x for x in t.split("\n") if xxhash.xxh64_intdigest(normalised(x.encode())) - (1 << 63) not in hashes)
            out.append(t)
        return type(text)(out, dtype=object)

    cleaned = kept.withColumn("text", F.when(F.size(removed) > 0, without("text", removed)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*columns_of(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, base_failed and kept of every document."""
    return judge(read(spark, sf_dir, "documents")).drop("row", "hash", "removed")
