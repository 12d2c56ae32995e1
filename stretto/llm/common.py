"""What the operators of this subpackage share: written tables, blocks of documents, linked components."""

from __future__ import annotations

import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; whole texts travel in batches, so these bound a worker's memory (a text beyond is a batch).
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all is one machine's process
    (tests) one of our own. A cluster without that setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stretto-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch in this session; settings that are smaller stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, most)


def give_back() -> None:
    """Returns a worker's free memory to the machine, at the end of a task that has held much."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Bytes of df's input as the planner knows them (file sizes); a scan measures what has no such figure."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = 64 * df.count()
    return size


def blocks(df: DataFrame, target: int = 12 << 20) -> int:
    """How many blocks of about target (compressed) input bytes df falls into; grows with the input, is never capped."""
    return max(1, -(-planned_bytes(df) // target))


def text_table(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named, whatever else docs carries."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def own_names(keep: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """Names under which columns to keep come back: own_ before one that an operator gives to a column of its own."""
    return {c: f"own_{c}" if c in taken else c for c in keep}


def block_of(column: Column, n: int) -> Column:
    """A row's block by hash; a null key has a block as well."""
    return F.pmod(F.xxhash64(column, F.lit(17)), F.lit(n)).cast("int")


def byte_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and its offsets, without copies of single values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under the links a-b (in one task's memory)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node that each node of the edge list reaches, by large-star and small-star rounds.

    Each round is two aggregations and joins over the links, its result a written table, so a lost executor repeats one
    round at most. No node's neighbours are gathered: a star's centre is an aggregate. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "links")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            break
        before = mark
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def arrow(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def packed_blocks(rows: DataFrame) -> DataFrame:
    """rows, which have a column block, as (block, packed): what a batch has of a block in one compressed value.

    Whole texts cross shuffles several times; this way they cross them small, and a block's rows are few.
    """
    names = [c for c in rows.columns if c != "block"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for b in batches:
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            columns = {c: b.column(c).to_pylist() for c in names}
            numbers, data = [], []
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
                numbers.append(int(block[own[0]]))
                data.append(squeeze.compress(pickle.dumps({c: [v[k] for k in own] for c, v in columns.items()}, 5)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["block", "packed"])

    return rows.mapInArrow(run, "block int, packed binary")


def unpacked(table: pa.Table, *names: str) -> list[list]:
    """The columns named of a block's rows from packed_blocks."""
    out: list[list] = [[] for _ in names]
    for data in table.column("packed").to_pylist():
        found = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        for own, c in zip(out, names):
            own += found[c]
    return out
