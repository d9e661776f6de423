"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from meshline.llm.alignment import op13_tokenizer_alignment
from meshline.llm.decontaminate import ORACLE as OP3_SQL, op3_decontaminate
from meshline.llm.fingerprint import op4_fingerprints
from meshline.llm.language import op7_language_id
from meshline.llm.licenses import op8_license_scan, oracle as op8_sql
from meshline.llm.lines import ORACLE as OP12_SQL, op12_line_dedup
from meshline.llm.packing import op1_packing
from meshline.llm.quality import op6_quality_knn
from meshline.llm.repair import op11_conversation_repair, oracle as op11_sql
from meshline.llm.simhash import op10_simhash_near_dedup
from meshline.llm.simple8b import op5_token_binary
from meshline.llm.suffixes import op2_suffix_dedup
from meshline.llm.toxicity import op9_toxicity_crf

QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_fingerprints": op4_fingerprints,
    "op5_token_binary": op5_token_binary,
    "op6_quality_knn": op6_quality_knn,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity_crf": op9_toxicity_crf,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op8_license_scan": op8_sql(),
    "op11_conversation_repair": op11_sql(),
    "op12_line_dedup": OP12_SQL,
}
