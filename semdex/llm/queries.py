"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semdex.llm import crf_toxicity, hilbert_sharding, mixing, mtree, packing, pu_quality, quality_rules, simhash, suffix_dedup, wordpiece
from semdex.llm.common import table


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _labelled(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pu_quality": _labelled(pu_quality.op1),
        "op2_suffix_array_dedup": _docs(suffix_dedup.op2),
        "op3_hilbert_sharding": _docs(hilbert_sharding.hilbert_shards),
        "op4_crf_toxicity": _labelled(crf_toxicity.op4),
        "op5_quality_rules": _docs(quality_rules.op5),
        "op6_simhash_near_dedup": _docs(simhash.op6),
        "op7_token_counts": _docs(wordpiece.op7),
        "op8_power_of_two_packing": _docs(packing.op8),
        "op9_sainte_lague_mixing": _docs(mixing.op9),
        "op10_mtree_top_k": lambda spark, sf_dir: mtree.op10(table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.oracle(), "op10_mtree_top_k": mtree.ORACLE}
