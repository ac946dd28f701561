"""The queries of this package and their SQL, for the entry file."""

from __future__ import annotations

from lithograph.llm.filter_audit import OP13_SQL, op13_filter_audit
from lithograph.llm.html_text import op6_html_extraction
from lithograph.llm.licenses import op8_licenses
from lithograph.llm.mixing import OP3_SQL, op3_mixing
from lithograph.llm.packing import op7_packing
from lithograph.llm.periodic_runs import op12_periodic_runs
from lithograph.llm.ppm import op5_language_model
from lithograph.llm.quality_classifier import op9_quality_classifier
from lithograph.llm.quality_rules import op2_quality_rules
from lithograph.llm.repeats import OP10_SQL, op10_suffix_array_dedup
from lithograph.llm.sharding import OP11_SQL, op11_sharding
from lithograph.llm.simhash import op4_simhash
from lithograph.llm.topk import OP1_SQL, op1_topk

QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_language_model": op5_language_model,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {"op1_topk": OP1_SQL, "op3_mixing": OP3_SQL, "op10_suffix_array_dedup": OP10_SQL, "op11_sharding": OP11_SQL, "op13_filter_audit": OP13_SQL}
