"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, exact_dedup, html_extract, langid, line_dedup, near_dedup, pii, runs, sharding, variants, warc, word_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.documents_query,
        "op2_decontaminate": decontam.documents_query,
        "op3_exact_dedup": exact_dedup.documents_query,
        "op4_line_dedup": line_dedup.documents_query,
        "op5_language": langid.documents_query,
        "op6_pii": pii.documents_query,
        "op7_near_dedup": near_dedup.documents_query,
        "op8_html": html_extract.pages_query,
        "op9_shard": sharding.documents_query,
        "op10_warc": warc.pages_query,
        "op11_variants": variants.documents_query,
        "op12_word_bpe": word_bpe.documents_query,
        "op13_runs": runs.documents_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontam.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
    }
