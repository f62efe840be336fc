"""The contract queries of this package and the SQL that some of them are held against."""

from __future__ import annotations

from canticle.llm.bytebpe import op9_byte_bpe
from canticle.llm.chat import op5_chat_formatting
from canticle.llm.fingerprint import op3_document_fingerprints
from canticle.llm.infill import OP13_SQL, op13_fill_in_middle
from canticle.llm.kneser_ney import op12_language_model
from canticle.llm.lines import OP4_SQL, op4_line_dedup
from canticle.llm.packing import op6_best_fit_packing
from canticle.llm.quality import OP8_SQL, op8_quality_rules
from canticle.llm.resample import OP11_SQL, op11_importance_resampling
from canticle.llm.sharding import op2_bounded_ring
from canticle.llm.simhash import op10_simhash_near_dedup
from canticle.llm.substring import op1_substring_dedup
from canticle.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bounded_ring": op2_bounded_ring,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_language_model": op12_language_model,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
