"""The registered queries of this package and their SQL, for the operators that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from dossiergrid.llm.decontamination import OP3_SQL, decontamination_proximity, op3_decontamination
from dossiergrid.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from dossiergrid.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from dossiergrid.llm.language_id import op4_language_id
from dossiergrid.llm.license_scan import op1_license_scan
from dossiergrid.llm.line_dedup import OP6_SQL, op6_line_dedup
from dossiergrid.llm.manifest import OP12_SQL, op12_merkle_manifest
from dossiergrid.llm.mixing import OP9_SQL, op9_mix_sources
from dossiergrid.llm.pii import op11_personal_data
from dossiergrid.llm.quality import op2_quality_classifier
from dossiergrid.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from dossiergrid.llm.token_counts import op10_token_counts
from dossiergrid.llm.vector_codes import OP13_SQL, op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_line_dedup": op6_line_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_mix_sources": op9_mix_sources,
        "op10_token_counts": op10_token_counts,
        "op11_personal_data": op11_personal_data,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
        "decontamination_proximity": decontamination_proximity,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_decontamination": OP3_SQL,
        "op5_jaccard_join": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op7_substring_dedup": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_mix_sources": OP9_SQL,
        "op12_merkle_manifest": OP12_SQL,
        "op13_vector_codes": OP13_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
