"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gleaner.llm.alignment import op12_tokenizer_alignment
from gleaner.llm.decontamination import OP9_SQL, op9_decontamination
from gleaner.llm.divergence import OP11_SQL, op11_source_divergence
from gleaner.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from gleaner.llm.html_extraction import OP4_SQL, op4_html_extraction
from gleaner.llm.packing import op13_best_fit_packing
from gleaner.llm.phrase_dedup import OP6_SQL, op6_phrase_dedup
from gleaner.llm.quality_gam import op7_quality
from gleaner.llm.sentencepiece_codec import op8_sentencepiece
from gleaner.llm.simhash import op10_simhash_dedup
from gleaner.llm.suffix_dedup import OP1_SQL, op1_suffix_array_dedup
from gleaner.llm.toxicity import op5_toxicity
from gleaner.llm.warc import op3_warc_derivatives

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_phrase_dedup": op6_phrase_dedup,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op4_html_extraction": OP4_SQL,
    "op6_phrase_dedup": OP6_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
}
