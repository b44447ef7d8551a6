from pyspark.sql import functions as F

from tarn.llm import subwords
from tarn.llm.common import read_table

from .helpers import documents, odd_rows


def test_op4_decodes_what_it_encodes(spark, sf, tmp_path):
    odd = documents(spark, odd_rows(), tmp_path / "documents.parquet")
    for docs, where in ((read_table(spark, sf, "documents"), sf), (odd, str(tmp_path))):
        want = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
        got = subwords.op4_sentencepiece(spark, where).select("doc_id", "decoded_sha256")
        assert sorted(map(str, got.collect())) == sorted(str(r).replace("d='", "decoded_sha256='") for r in want.collect())
