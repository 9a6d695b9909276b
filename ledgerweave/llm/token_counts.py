"""Token counts of documents in flat token files, by scanning for the end-of-document id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import read, record, slices, stored, texts
from ledgerweave.llm.tokens import END_OF_TEXT, WORD_BPE, word_tokenizer

#: Tokens in a block of a file, cut without regard to documents, and blocks after which a file ends with its document.
BLOCK_TOKENS = 1 << 18
FILE_BLOCKS = 256
DTYPE = "<u2"


def write_flat(docs: DataFrame, tokenizer: str = WORD_BPE, end: int = END_OF_TEXT, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens (bytes), and doc_ids of the documents that end in the block, for docs (doc_id, text).

    The files hold nothing but ids and, after each document, end. Strings of special tokens in a text are ordinary text
    here, so that no text can forge an end. doc_ids is for naming results; the scan doesn't read it. Null and empty texts
    are the end alone; repeated rows are written as often as they come; an empty table gives no blocks. An id that dtype
    can't hold raises a ValueError.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("tokens", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
    width, most = np.dtype(dtype).itemsize, np.iinfo(dtype).max

    def run(batches):
        tok, size = word_tokenizer(tokenizer, plain=True), block_tokens * width
        task, file, block, held, held_bytes, ended = TaskContext.get().partitionId(), 0, 0, [], 0, []

        def blocks(final: bool):
            nonlocal block, held, held_bytes, ended
            data, at = b"".join(held), 0
            while len(data) - at >= size or final and at < len(data):
                upto = min(at + size, len(data))
                mine = [d for d, e in ended if e <= upto]
                ended = ended[len(mine) :]
                yield record(schema, file=[f"{task:06d}-{file:06d}"], block=[block], tokens=[data[at:upto]], doc_ids=[mine])
                block, at = block + 1, upto
            held, held_bytes = [data[at:]], len(data) - at
            ended = [(d, e - at) for d, e in ended]

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                ids = np.frombuffer(tok.ids(text) + np.array([end], "<u4").tobytes(), "<u4")
                if ids.max() > most:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}")
                ids = ids.astype(dtype).tobytes()
                held.append(ids)
                held_bytes += len(ids)
                ended.append((doc_id, held_bytes))
            if held_bytes >= size:
                yield from blocks(False)
            if block >= FILE_BLOCKS:  # files end where a document ends
                yield from blocks(True)
                file, block = file + 1, 0
        yield from blocks(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, block int, tokens binary, doc_ids array<long>")


def read_raw(spark: SparkSession, path: str, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens of raw flat files (ids only, little-endian) under a path that Spark's readers open."""
    size = block_tokens * np.dtype(dtype).itemsize
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("int"))).alias("block")
    cut = whole.select("file", "content", starts)
    return cut.select("file", "block", F.substring(F.col("content"), F.col("block") * size + 1, F.lit(size)).alias("tokens"))


def scan(blocks: DataFrame, end: int = END_OF_TEXT, dtype: str = DTYPE) -> DataFrame:
    """file, document (from 0 in its file), block, place (in its block), start, n_tokens and terminated, for each document.

    blocks: file, block, tokens. n_tokens doesn't count the end. What follows a file's last end is a document with
    terminated false, with block and place null; an empty rest is none. Null tokens are an empty block; empty files and
    tables give no rows. Blocks are numbered in order within a file; gaps are fine.

    Each block is searched by itself; a prefix scan over one row for each block says how many tokens and documents come
    before it and where the last end lies, which stitches the documents that cross from block to block.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("n", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def search(batches):
        for batch in slices(batches, 16):
            sizes, ends = [], []
            for raw in batch.column("tokens").to_pylist():
                ids = np.frombuffer(raw or b"", dtype)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end).astype(np.int32))
            yield record(schema, file=batch.column("file"), block=batch.column("block"), n=sizes, ends=ends)

    found = stored(blocks.select("file", F.col("block").cast("int"), "tokens").mapInArrow(search, "file string, block int, n long, ends array<int>"))
    light = found.select("file", "block", "n", F.size("ends").alias("documents"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = light.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("documents").over(before), F.lit(0)))
    at = at.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    each = found.join(at.select("file", "block", "base", "first", "open"), ["file", "block"])
    # the token after the end before this one, which may lie in an earlier block
    begin = F.when(F.col("place") == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("place"), F.lit(1))) + 1)
    each = each.select("file", "block", "base", "first", "open", "ends", F.posexplode("ends").alias("place", "end"))
    each = each.withColumn("start", begin.cast("long"))
    closed = each.select("file", (F.col("first") + F.col("place")).cast("long").alias("document"), "block", "place", "start", (F.col("base") + F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = at.groupBy("file").agg(F.sum("n").alias("n"), F.sum("documents").cast("long").alias("document"), F.max(F.coalesce(F.col("base") + F.col("last") + 1, F.lit(0))).alias("start")).where("n > start")
    none = F.lit(None).cast("int")
    return closed.unionByName(rest.select("file", "document", none.alias("block"), none.alias("place"), "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = stored(write_flat(read(spark, sf_dir, "documents")))
    names = flat.select("file", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    counted = scan(flat.select("file", "block", "tokens"))
    return counted.join(names, ["file", "block", "place"]).select("doc_id", "file", "document", "start", "n_tokens", "terminated")
