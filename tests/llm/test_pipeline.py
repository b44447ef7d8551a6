import corpus_pipeline
from pyspark.sql import functions as F

from .helpers import documents, odd_rows
from .test_simhash import plain_near_copies


def kept_of(rows):
    """The documents that language ID, exact dedup and near dedup leave: by text, the largest doc_id of equal texts, then the smallest of near copies."""
    by_text = {}
    for d, t, *_ in rows:
        if t and any(c.isalpha() for c in t):
            by_text[t] = max((x for x in (by_text.get(t), d) if x is not None), default=None)
    left = sorted(by_text.items(), key=lambda x: (x[1] is None, x[1] or 0))
    groups = plain_near_copies([t for t, _ in left])
    return sorted(str(d) for k, ((_, d), g) in enumerate(zip(left, groups, strict=True)) if k == g)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = odd_rows() + [(100 + k, f"the house number {k} and the dog of the {k} neighbours", "en") for k in range(12)] + [(300, None, "de"), (301, "²", None)]
    documents(spark, rows, tmp_path / "documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(str(r.doc_id) for r in got.where("start = 0").collect()) == kept_of(rows)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = odd_rows()
    docs = documents(spark, rows, tmp_path / "d")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert 0 < out.count() <= len(rows)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


def test_empty_table(spark, tmp_path):
    documents(spark, odd_rows()).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
