"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, fingerprints, licenses, line_dedup, mixing, near_dedup, ogg, packing, pii, quality, ranking, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": near_dedup.op1_jaccard_join,
        "op2_pii": pii.op2_pii,
        "op3_ogg": ogg.op3_ogg,
        "op4_quality": quality.op4_quality,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_shard": sharding.op6_shard,
        "op7_fuzzy_lines": line_dedup.op7_fuzzy_lines,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_licenses": licenses.op9_licenses,
        "op10_pack": packing.op10_pack,
        "op11_rank": ranking.op11_rank,
        "op12_align": alignment.op12_align,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.OP5_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_rank": ranking.OP11_SQL}
