"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

import corpus_pipeline
from rollcall.llm.byte_bpe import op10_byte_bpe
from rollcall.llm.embedding_dedup import op6_embedding_near_dedup
from rollcall.llm.extraction import op5_html_extraction
from rollcall.llm.fill_in_middle import op12_fill_in_middle
from rollcall.llm.language import op2_language_id
from rollcall.llm.licenses import op7_license_scan
from rollcall.llm.line_dedup import op3_line_dedup
from rollcall.llm.minhash import op8_minhash_near_dedup
from rollcall.llm.oracles import ORACLES as ORACLES
from rollcall.llm.packing import op9_packing
from rollcall.llm.passage_dedup import op11_passage_dedup
from rollcall.llm.periodic_runs import op13_periodic_runs
from rollcall.llm.quality import op4_quality_rules
from rollcall.llm.substring_dedup import op1_suffix_array_dedup

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_passage_dedup": op11_passage_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
