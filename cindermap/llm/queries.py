"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from cindermap.llm.align import op12_tokenizer_alignment
from cindermap.llm.ann import op1_permutation_index
from cindermap.llm.decontaminate import op5_benchmark_decontamination
from cindermap.llm.linedup import OP9_SQL, op9_line_dedup
from cindermap.llm.packing import op10_best_fit_packing
from cindermap.llm.shards import op6_size_tiered_shards
from cindermap.llm.simhash import op2_simhash_near_dedup
from cindermap.llm.spelling import op13_spelling_variants
from cindermap.llm.substrings import op4_repeated_passages
from cindermap.llm.tokenbin import op8_token_files
from cindermap.llm.topk import OP11_SQL, op11_exact_top_k
from cindermap.llm.toxicity import op3_toxicity
from cindermap.llm.warc import OP7_SQL, op7_warc_archives

QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_size_tiered_shards": op6_size_tiered_shards,
    "op7_warc_archives": op7_warc_archives,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op7_warc_archives": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_exact_top_k": OP11_SQL}
