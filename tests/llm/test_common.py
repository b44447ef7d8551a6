import pytest

from tarn.llm import exact_dedup, pii, simhash, suffix_dedup
from tarn.llm.common import ROW_ID, stable, with_row_id

from .helpers import WORDS, documents

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split(spark):
    """Sets the size of a scan's parts; the scan that was split otherwise goes on with its own."""
    old = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set(SPLIT, size)
    for k, v in old.items():
        spark.conf.set(k, v)


def many(spark, path):
    rows = [(k, f"{' '.join(WORDS[(k * j) % len(WORDS)] for j in range(1, 60))} {k % 300} mail a{k % 40}@x.example.com") for k in range(900)]
    documents(spark, rows).repartition(6).sortWithinPartitions("doc_id").write.option("parquet.block.size", "20000").option("parquet.page.size.row.check.min", "10").parquet(str(path))
    return spark.read.parquet(str(path))


def test_numbers_do_not_depend_on_how_a_scan_is_split(spark, tmp_path, split):
    docs = many(spark, tmp_path / "d")
    found = []
    for size in ("64m", "30k", "7k"):
        split(size)
        found.append({r.doc_id: r[ROW_ID] for r in with_row_id(docs.select("doc_id", "text").where("doc_id > 3")).select("doc_id", ROW_ID).collect()})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 896
    assert spark.read.parquet(str(tmp_path / "d")).rdd.getNumPartitions() > 6


@pytest.mark.parametrize("stage", [exact_dedup.exact_dedup_stage, simhash.near_dedup_stage, pii.pii_stage])
def test_stages_when_the_split_changes_between_scans(spark, tmp_path, split, stage):
    docs = many(spark, tmp_path / "d")
    split("64m")
    want = sorted(map(str, stage(spark, docs, "").collect()))
    lazy = stage(spark, docs, "")
    split("7k")
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(map(str, lazy.collect())) == want == sorted(map(str, stage(spark, docs, "").collect()))


def test_substring_dedup_when_the_split_changes(spark, tmp_path, split):
    docs = many(spark, tmp_path / "d")
    split("64m")
    want = sorted(map(str, suffix_dedup.repeated_bytes(docs).collect()))
    split("7k")
    assert sorted(map(str, suffix_dedup.repeated_bytes(docs).collect())) == want


def test_rows_that_are_in_no_file_are_written_once(spark):
    docs = documents(spark, [(k, f"text {k % 3}") for k in range(9)])
    assert stable(docs).columns == docs.columns and stable(docs).inputFiles()
    assert with_row_id(docs.select("doc_id")).select(ROW_ID).distinct().count() == 9
    assert exact_dedup.exact_dedup_stage(spark, docs, "").count() == 3
