"""The corpus operators' queries and SQL."""

from __future__ import annotations

from . import exact_dedup, fingerprints, html_text, near_join, packing, pieces, pii, pitman_yor, quality, sharding


def queries() -> dict:
    return {
        "op10_max_plus_pieces": pieces.op10_max_plus_pieces,
        "op1_pitman_yor": pitman_yor.op1_pitman_yor,
        "op2_histogram_sort": sharding.op2_histogram_sort,
        "op3_boosted_dom": html_text.op3_boosted_dom,
        "op4_semi_markov_pii": pii.op4_semi_markov_pii,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_bradley_terry": quality.op6_bradley_terry,
        "op7_packing": packing.op7_packing,
        "op8_minhash_join": near_join.op8_minhash_join,
        "op9_scaled_sketch": fingerprints.op9_scaled_sketch,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.OP5_SQL}
