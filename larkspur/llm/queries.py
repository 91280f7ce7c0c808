"""Registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from .codes import OP12_SQL, op12_vector_codes
from .dedup import op1_setsketch_dedup
from .leaks import OP11_SQL, op11_fm_index
from .middle import OP13_SQL, op13_fill_in_middle
from .mixing import OP8_SQL, op8_mix
from .order import op10_order
from .packing import op6_best_fit
from .quality import OP3_SQL, op3_adaptive_quality
from .repeats import op4_prefix_free
from .secrets import op5_secret_forest
from .topk import OP7_SQL, op7_exact_topk
from .urls import OP2_SQL, op2_link_trust
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_setsketch_dedup": op1_setsketch_dedup,
    "op2_link_trust": op2_link_trust,
    "op3_adaptive_quality": op3_adaptive_quality,
    "op4_prefix_free": op4_prefix_free,
    "op5_secret_forest": op5_secret_forest,
    "op6_best_fit": op6_best_fit,
    "op7_exact_topk": op7_exact_topk,
    "op8_mix": op8_mix,
    "op9_warc": op9_warc,
    "op10_order": op10_order,
    "op11_fm_index": op11_fm_index,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {
    "op2_link_trust": OP2_SQL,
    "op3_adaptive_quality": OP3_SQL,
    "op7_exact_topk": OP7_SQL,
    "op8_mix": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op11_fm_index": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
