"""Exact dedup by two passes over a Bloom filter.

Pass one sets, for every text hash, two bits of a filter and notes bits that are set again ("twice"). A hash whose
bits were all set twice is possibly repeated. Pass two lets every other row straight through: only possibly repeated
rows shuffle, as (hash, id), and are grouped exactly by SHA-256. A too full filter costs shuffle, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import ROW_ID, arrow_schema, checkpoint, read_table, stable, with_row_id, without_rows

#: The filter has BITS_PER_ROW bits for each row, within these bounds (as powers of two). The upper one, 32 MB, bounds what is broadcast.
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 16, 28
SEGMENT_BYTES = 1 << 15


def filter_bits(rows: int) -> int:
    return 1 << min(MOST_BITS, max(LEAST_BITS, (rows * BITS_PER_ROW - 1).bit_length()))


def bit_positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def possibly_repeated(hashes: DataFrame, bits: int, tasks: int) -> np.ndarray:
    """The bits set twice, of a table of one long column h; merged by segment on the executors."""
    schema = arrow_schema("segment int, once binary, twice binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            first, second = bit_positions(batch.column(0).to_numpy(zero_copy_only=False), bits)
            # a hash counts once at a bit even where its two positions are the same
            at, n = np.unique(np.concatenate([first, second[second != first]]), return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            again = (n > 1) | ((once[byte] & bit) > 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        step = min(SEGMENT_BYTES, bits // 8)
        for k in range(bits // 8 // step):
            part = slice(k * step, (k + 1) * step)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[part].tobytes()], pa.binary()), pa.array([twice[part].tobytes()], pa.binary())], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        once = twice = None
        for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if once is None:
                once, twice = a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
        return pa.table({"segment": table.column("segment").slice(0, 1), "twice": pa.array([twice.tobytes()], pa.binary())})

    # A task of the first pass writes up to bits / 4 bytes, so there are as many tasks as have about bits / 16 rows each.
    parts = hashes.select("h").coalesce(tasks).mapInArrow(build, "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(merge, "segment int, twice binary")
    found, step = np.zeros(bits // 8, np.uint8), min(SEGMENT_BYTES, bits // 8)
    for row in merged.toLocalIterator():  # at most bits / 8 bytes in all
        found[row.segment * step : (row.segment + 1) * step] = np.frombuffer(row.twice, np.uint8)
    return found


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row per row of docs: __row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text. Of equal texts the row with the largest doc_id stays (nulls count as smallest); of
    rows that also share that doc_id exactly one stays. An empty table gives no rows.
    """
    spark = docs.sparkSession
    hashed = with_row_id(docs.select("doc_id", "text")).select(ROW_ID, "doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    hashed = checkpoint(hashed.withColumn("h", F.xxhash64("text_sha256")), docs.count(), docs)
    rows = hashed.count()
    bits = filter_bits(rows)
    tasks = max(8, rows * BITS_PER_ROW // bits)
    twice = spark.sparkContext.broadcast(possibly_repeated(hashed, bits, tasks))
    ddl = f"{ROW_ID} long, doc_id long, text_sha256 string, maybe boolean"
    schema = arrow_schema(ddl)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            for at in bit_positions(batch.column("h").to_numpy(zero_copy_only=False), bits):
                maybe &= (twice.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([batch.column(ROW_ID), batch.column("doc_id").cast(pa.int64()), batch.column("text_sha256").cast(pa.string()), pa.array(maybe)], schema=schema)

    marked = hashed.mapInArrow(mark, ddl)
    alone = marked.where(~F.col("maybe")).select(ROW_ID, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.where("maybe").select(ROW_ID, "doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", ROW_ID)).alias("keep"), F.count("*").alias("group_size"))
    # A hot group is one row on the right. Its name there is computed anew, so that the right side has a shuffle of its own, after the
    # aggregation: only then may Spark split the hot partition of the left side.
    groups = groups.select(F.substring("text_sha256", 1, 64).alias("of"), "keep", "group_size")
    grouped = maybe.join(groups, F.col("text_sha256") == F.col("of")).select(ROW_ID, "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col(ROW_ID) == F.col(f"keep.{ROW_ID}")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop(ROW_ID)


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that exact_dedup does not keep: of equal texts (null as empty) the largest doc_id stays, of rows that share that one too exactly
    one. All columns stay as they are, whatever their names; an empty table gives no rows."""
    docs = stable(docs)
    gone = exact_dedup(docs).where(~F.col("kept")).select(ROW_ID)
    return without_rows(docs, gone)
