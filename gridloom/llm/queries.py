"""The queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import clustering, html_text, media, mixing, near_duplicates, ngram_join, packing, quality, sharding, spelling, token_files, url_lists, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bounded_ring_sharding": sharding.op1,
        "op2_winnowing_fingerprints": winnowing.op2,
        "op3_html_block_extraction": html_text.op3,
        "op4_systematic_mixing": mixing.op4,
        "op5_quadratic_quality": quality.op5,
        "op6_temporal_url_lists": url_lists.op6,
        "op7_addressable_token_files": token_files.op7,
        "op8_spectral_media": media.op8,
        "op9_ngram_jaccard_join": ngram_join.op9,
        "op10_vector_best_fit": packing.op10,
        "op11_hamerly_clusters": clustering.op11,
        "op12_minhash_near_duplicates": near_duplicates.op12,
        "op13_spelling_variants": spelling.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_systematic_mixing": mixing.OP4_SQL, "op6_temporal_url_lists": url_lists.OP6_SQL, "op11_hamerly_clusters": clustering.OP11_SQL, "op12_minhash_near_duplicates": near_duplicates.OP12_SQL, "op13_spelling_variants": spelling.OP13_SQL}
