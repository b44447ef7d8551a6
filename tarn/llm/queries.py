"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import exact_dedup, html_text, language, media, packing, pii, secrets, simhash, subwords, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_simhash": simhash.op3_simhash,
        "op4_sentencepiece": subwords.op4_sentencepiece,
        "op5_html": html_text.op5_html,
        "op6_language": language.op6_language,
        "op7_secrets": secrets.op7_secrets,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_media": media.op9_media,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.OP8_SQL}
