"""The queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from quern.llm import cover_tree
from quern.llm.ann import op6_nearest
from quern.llm.bpe import op7_bpe
from quern.llm.cover_tree import op4_top_k
from quern.llm.html_extract import op3_html_extraction
from quern.llm.lm_scoring import op1_lm_scoring
from quern.llm.mixing import op2_mixing
from quern.llm.quality import op10_quality_classifier
from quern.llm.secrets import op9_secret_scans
from quern.llm.sentence_spans import op8_substring_dedup
from quern.llm.simhash import op5_simhash

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_top_k": op4_top_k,
    "op5_simhash": op5_simhash,
    "op6_nearest": op6_nearest,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_quality_classifier": op10_quality_classifier,
}

#: The others need XXH64, compression, tokenizers, training, HTML parsing or random draws, which SQL has not.
ORACLES = {"op4_top_k": cover_tree.ORACLE}
