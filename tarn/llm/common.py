"""What the operators of this package share: reading, checkpoints, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import share_package
from tarn.session import shared_folder as shared_dir

#: Rows that a Python function sees at once; keeps the Python copies of long texts small.
SLICE_ROWS = 512
#: Name of the column that tells rows apart, null or repeated doc_ids included.
ROW_ID = "__row_id"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(docs: DataFrame) -> tuple[Column, Column] | None:
    """File and index in it of each row, where docs is a scan of Parquet files (or narrow steps over one)."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_path"], meta["row_index"])
    except AnalysisException:
        return None
    return meta["file_path"], meta["row_index"]


def stable(docs: DataFrame) -> DataFrame:
    """docs, or a copy of it in the shared folder if its rows can't be told apart by their place in Parquet files."""
    share_package(docs.sparkSession)
    if _place(docs):
        return docs
    path = f"{shared_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def with_row_id(docs: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Adds a column that numbers the rows of stable(docs), the same each time it is computed, however the scan is split.

    A number is a hash of the file's path over the row's index in it. The files are few beside the rows, so they come to the
    driver, which takes the first seed that tells them all apart.
    """
    docs = stable(docs)
    file, index = _place(docs)
    files = docs.select(file.alias("f"), index.alias("i")).groupBy("f").agg(F.max("i").alias("i")).collect()
    bits = max([1, *(r.i.bit_length() for r in files)])
    mask = (1 << (63 - bits)) - 1
    for seed in range(100):
        if len({xxhash.xxh64_intdigest(f"{seed} {r.f}".encode(), 42) & mask for r in files}) == len(files):
            hashed = F.xxhash64(F.concat(F.lit(f"{seed} "), file)).bitwiseAND(F.lit(mask))
            return docs.select("*", F.shiftleft(hashed, bits).bitwiseOR(index).alias(name))
    raise ValueError(f"{len(files)} files of up to {1 << bits} rows are too many to number")


def free_name(docs: DataFrame, like: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{like}{k or ''}") not in taken)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, which is stable, without the rows whose numbers are in gone's ROW_ID."""
    name = free_name(docs, ROW_ID)
    return compact(with_row_id(docs, name).join(gone.select(F.col(ROW_ID).alias(name)), name, "left_anti").drop(name), docs.count(), docs)


#: A checkpoint or a stage's result has a file for so many rows, or bytes that the files read for it have, and these at least if there are
#: as many parts.
ROWS_PER_FILE, BYTES_PER_FILE, LEAST_FILES = 100_000, 128 << 20, 24


def compact(df: DataFrame, rows: int, source: DataFrame | None = None) -> DataFrame:
    """df, of about so many rows, in no more parts than files of a fair size need. source: the scan that it comes from in one step, if any."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if source is not None else 0
    return df.coalesce(min((1 << 31) - 1, max(LEAST_FILES, rows // ROWS_PER_FILE, size // BYTES_PER_FILE)))


def checkpoint(df: DataFrame, rows: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read back: it survives lost executors and cuts the lineage.

    rows, source: as of compact, for fewer files than there are parts.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else compact(df, rows, source)).checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


_kept: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task. It keeps one such thing, so that one operator's words don't stay while the next one works."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Frees what another operator's tasks have left in this worker."""
    _kept.clear()


def columns_of(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def map_columns(df: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], out: str | T.StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow for functions from dicts of column lists to dicts of column lists (or arrays)."""
    schema = arrow_schema(out)
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # those that live on words don't come through here
        for made in function(columns_of(batches, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, out)
