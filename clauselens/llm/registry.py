"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from .bpe import op6_query
from .chat_format import OP8_SQL, op8_query
from .exact_dedup import OP5_SQL, op5_query
from .language_id import op1_query
from .license_scan import op9_query
from .packing import OP4_SQL, op4_query
from .secrets import op10_query
from .simhash import op7_query
from .token_files import op2_query
from .weighted_sampling import op3_query

QUERIES = {
    "op1_language_id": op1_query,
    "op2_token_bits": op2_query,
    "op3_weighted_sampling": op3_query,
    "op4_length_buckets": op4_query,
    "op5_exact_dedup": op5_query,
    "op6_pair_index_bpe": op6_query,
    "op7_simhash_balls": op7_query,
    "op8_chat_format": op8_query,
    "op9_license_scan": op9_query,
    "op10_secret_scan": op10_query,
}
ORACLE = {
    "op4_length_buckets": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_chat_format": OP8_SQL,
}
