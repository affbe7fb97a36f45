"""The queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from logweir.llm import bpe, dac, langid, licenses, mixing, mpeg, neighbors, simhash, suffix, toxicity


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix.op1_suffix,
        "op2_byte_bpe": bpe.op2_bpe,
        "op3_pruned_graph": neighbors.op3_graph,
        "op4_simhash_anchors": simhash.op4_simhash,
        "op5_pareto_mix": mixing.op5_mixing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_langid": langid.op7_langid,
        "op8_dac": dac.op8_dac,
        "op9_mpeg_audio": mpeg.op9_mpeg,
        "op10_license_join": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_pareto_mix": mixing.OP5_SQL,
        "op10_license_join": licenses.OP10_SQL,
    }
