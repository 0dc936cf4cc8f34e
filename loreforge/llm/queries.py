"""The registered queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .centroids import OP11_SQL, op11_centroid_clustering
from .chat import op2_chat_formatting
from .decontaminate import OP9_SQL, op9_decontamination
from .html_main import op5_html_extraction
from .lines import OP8_SQL, op8_line_dedup
from .maxent import op10_lm_scoring
from .mixing import OP7_SQL, op7_mixing
from .near_dup import op6_near_dedup
from .packing import op12_packing
from .quality import op1_quality_rules
from .rollup import op3_token_rollup
from .substring import OP4_SQL, op4_substring_dedup

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_token_rollup": op3_token_rollup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_near_dedup": op6_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
