"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_phrase_collocations
from .decontamination import OP8_SQL, op8_decontamination
from .fingerprints import op3_fingerprints
from .language_id import op9_language_id
from .near_duplicates import OP2_SQL, op2_near_duplicates
from .nearest import OP13_SQL, op13_exact_top_k
from .packing import op4_best_fit_packing
from .periodic_runs import OP12_SQL, op12_periodic_runs
from .repeated_spans import OP10_SQL, op10_repeated_spans
from .token_files import op1_token_files
from .url_filter import op6_url_filter
from .warc import OP5_SQL, op5_warc_revisits
from .word_pieces import op7_token_counts

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_fingerprints": op3_fingerprints,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_repeated_spans": op10_repeated_spans,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_top_k": op13_exact_top_k,
}
ORACLES: dict[str, str] = {"op2_near_duplicates": OP2_SQL, "op5_warc_revisits": OP5_SQL, "op8_decontamination": OP8_SQL, "op10_repeated_spans": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_exact_top_k": OP13_SQL}
