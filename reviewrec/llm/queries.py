"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_decontamination
from .html import op3_html_extraction
from .langid import op2_language_id
from .lines import op8_line_dedup
from .near import op5_near_duplicates
from .packing import op1_packing
from .quality import OP13_SQL, op13_quality_rules
from .ranked import OP12_SQL, op12_ranked_search
from .substrings import op4_suffix_array, op9_substring
from .topk import OP6_SQL, op6_exact_topk
from .toxicity import op7_toxicity
from .trie import OP11_SQL, op11_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_suffix_array": op4_suffix_array,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_exact_topk": op6_exact_topk,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring": op9_substring,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op6_exact_topk": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_quality_rules": OP13_SQL}
