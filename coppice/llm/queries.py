"""Queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

import corpus_pipeline
from coppice.llm import alignment, avi, decontamination, finite_tokens, infill, line_dedup, packing, pii, sharding, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_warc_normaliser": warc.op6_warc_normaliser,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_pii_deobfuscation": pii.op8_pii_deobfuscation,
    "op9_virtual_slots": sharding.op9_virtual_slots,
    "op10_avi_motion_jpeg": avi.op10_avi_motion_jpeg,
    "op11_token_counts": finite_tokens.op11_token_counts,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLES = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op6_warc_normaliser": warc.OP6_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
