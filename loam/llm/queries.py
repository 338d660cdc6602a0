"""The training-data operators as registered queries, each over its whole table."""

from __future__ import annotations

from .embeddings import op2_embeddings
from .leaks import op7_leaks
from .lines import op3_line_dedup
from .oracles import OP2_SQL, OP3_SQL, OP5_SQL
from .packing import op6_packing
from .quality import op10_quality
from .sharding import op4_sharding
from .simhash import op1_simhash
from .substrings import op5_substrings
from .tokens import op8_token_counts
from .urls import OP9_SQL, op9_url_filters

QUERIES = {f.__name__: f for f in (op1_simhash, op2_embeddings, op3_line_dedup, op4_sharding, op5_substrings, op6_packing, op7_leaks, op8_token_counts, op9_url_filters, op10_quality)}

ORACLES: dict[str, str] = {"op2_embeddings": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_substrings": OP5_SQL, "op9_url_filters": OP9_SQL}
