"""The training-data queries, and SQL for those that it can express."""

from __future__ import annotations

from tessera.llm import audio, dedup, huffman, mixing, packing, quality, sharding, toxicity, urls, winnowing


def queries() -> dict:
    return {
        "op1_minhash_groups": dedup.op1_minhash_groups,
        "op2_quality_trees": quality.op2_quality_trees,
        "op3_mixing_tree": mixing.op3_mixing_tree,
        "op4_best_fit": packing.op4_best_fit,
        "op5_toxic_grammar": toxicity.op5_toxic_grammar,
        "op6_jump_hash": sharding.op6_jump_hash,
        "op7_huffman": huffman.op7_huffman,
        "op8_winnowing": winnowing.op8_winnowing,
        "op9_chroma": audio.op9_chroma,
        "op10_url_cascade": urls.op10_url_cascade,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_groups": dedup.ORACLE, "op10_url_cascade": urls.ORACLE}
