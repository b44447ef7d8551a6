"""Documents to packed sequences: language ID, exact dedup, SimHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
run() writes each stage's rows as Parquet to the folder that the cluster shares and reads them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import exact_dedup, language, packing, pii, simhash
from tarn.llm.common import read_table
from tarn.session import remove, shared_folder

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language.language_stage),
    ("exact_dedup", exact_dedup.exact_dedup_stage),
    ("near_dedup", simhash.near_dedup_stage),
    ("pii", pii.pii_stage),
    ("packing", packing.packing_stage),
]

#: SQL can express neither the SVMs nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of the documents in sf_dir. Null, empty and letterless texts go in the first stage; further columns of any name
    come through to the last but one; an empty table gives no rows. Each stage's docstring says what it does to ties and repeated rows."""
    docs, base, last = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # only the last stage's rows are read from now on
            remove(spark, last)
        last = path
    return docs
