"""The registered queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lastmile.llm import twins
from lastmile.llm.language_id import op9_language_id
from lastmile.llm.license_scan import op12_license_scan
from lastmile.llm.minhash import op6_minhash_dedup
from lastmile.llm.mixing import op3_mixing
from lastmile.llm.packing import op4_packing
from lastmile.llm.periodic_runs import op13_periodic_runs
from lastmile.llm.quality import op7_quality_rules
from lastmile.llm.sharding import op2_sharding
from lastmile.llm.substring_dedup import op1_substring_dedup
from lastmile.llm.token_alignment import op11_token_alignment
from lastmile.llm.token_counts import op10_token_counts
from lastmile.llm.toxicity import op8_toxicity
from lastmile.llm.vector_search import op5_vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sharding": op2_sharding,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_vector_search": op5_vector_search,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_language_id": op9_language_id,
        "op10_token_counts": op10_token_counts,
        "op11_token_alignment": op11_token_alignment,
        "op12_license_scan": op12_license_scan,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": twins.repeated_windows(),
        "op6_minhash_dedup": twins.near_duplicates(),
        "op12_license_scan": twins.license_scan(),
    }
