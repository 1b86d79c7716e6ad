"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from clausegraph.llm.ctw import op9_ctw
from clausegraph.llm.divergence import OP12_SQL, op12_divergence
from clausegraph.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from clausegraph.llm.html_text import op7_main_text
from clausegraph.llm.langid import op8_language
from clausegraph.llm.mixing import op1_mixing
from clausegraph.llm.packing import op6_packing
from clausegraph.llm.quality import op2_quality
from clausegraph.llm.simhash import op3_simhash
from clausegraph.llm.token_files import op5_token_files
from clausegraph.llm.url_filter import OP13_SQL, op13_url_filter
from clausegraph.llm.vector_codes import OP11_SQL, op11_vector_codes
from clausegraph.llm.warc import op4_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_main_text": op7_main_text,
    "op8_language": op8_language,
    "op9_ctw": op9_ctw,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_divergence": op12_divergence,
    "op13_url_filter": op13_url_filter,
}
ORACLES = {"op10_exact_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_divergence": OP12_SQL, "op13_url_filter": OP13_SQL}
