"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a task, so that Python holds few texts whatever the Arrow batch size is.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the context's checkpoint folder.

    Where both are unset, a temporary one is made if driver and tasks share a machine (a local master, as in tests); on a
    cluster executors could not read that, so a ValueError is raised.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir().get()
    return folder


_cleaned: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may have ended first; the files are only scratch
        pass


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage and survives lost executors.

    The tables of an application are deleted when its Python process ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/ledgerweave-{spark.sparkContext.applicationId}"
    if home not in _cleaned:
        _cleaned.add(home)
        atexit.register(_remove, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: Iterable[str], name: str) -> str:
    """name, with underscores before it until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_key(column: str) -> Column:
    """A hash of a text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def numbered(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The given columns with row, a number of each row (first: its place in its partition, which a retried task repeats)."""
    return df.select(F.monotonically_increasing_id().alias("row"), *columns)


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo modulus; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    values = batch.column(name).cast(pa.large_binary()).to_pylist()
    return [v or b"" for v in values]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null is empty."""
    return [v or "" for v in batch.column(name).to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((f.name, columns[f.name]) for f in schema)],
        schema=schema,
    )
