"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, infill, kdtree, lines, packing
from .decontaminate import op12_decontamination
from .hmm import op4_hmm
from .html import op7_html_text
from .infill import op11_fill_in_middle
from .kdtree import op10_kdtree
from .lines import op5_line_dedup
from .packing import op9_packing
from .partitions import op3_learned_partitions
from .periodic import op13_periodic_runs
from .pieces import op1_token_counts, op6_sentencepiece
from .simhash import op8_simhash
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_learned_partitions": op3_learned_partitions,
    "op4_hmm": op4_hmm,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_text": op7_html_text,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_kdtree": op10_kdtree,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": lines.ORACLE,
    "op9_packing": packing.ORACLE,
    "op10_kdtree": kdtree.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op12_decontamination": decontaminate.ORACLE,
}
