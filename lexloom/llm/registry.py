"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import corpus_pipeline
from lexloom.llm import binary, chat, flac, langid, mixing, packing, quality, simhash, spelling, suffix, toxicity, whitening, windows


def queries() -> dict:
    return {
        "op1_spf_packing": packing.op1_spf_packing,
        "op10_flac_columns": flac.op10_flac_columns,
        "op2_toxicity_cnn": toxicity.op2_toxicity_cnn,
        "op3_byte_cnn_langid": langid.op3_byte_cnn_langid,
        "op4_suffix_dedup": suffix.op4_suffix_dedup,
        "op5_poisson_mix": mixing.op5_poisson_mix,
        "op6_simhash_pigeonring": simhash.op6_simhash_pigeonring,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_binary_output": binary.op8_binary_output,
        "pipeline": corpus_pipeline.run,
        "op9_quality_rules": quality.op9_quality_rules,
        "op11_window_dedup": windows.op11_window_dedup,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_bitsliced_whitening": whitening.op13_bitsliced_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_dedup": suffix.OP4_SQL, "op5_poisson_mix": mixing.OP5_SQL, "op7_chat_formatting": chat.OP7_SQL, "op9_quality_rules": quality.OP9_SQL, "op11_window_dedup": windows.OP11_SQL, "op12_spelling_variants": spelling.OP12_SQL}
