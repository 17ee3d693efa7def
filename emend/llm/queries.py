"""The operators' registered queries and their SQL."""

from __future__ import annotations

from .alignment import op13_token_alignment
from .ann import op4_nearest
from .chat import OP1_SQL, op1_chat_format
from .jaccard import OP2_SQL, op2_ngram_jaccard
from .langid import op3_language_id
from .mixing import OP5_SQL, op5_mix
from .packing import op9_best_fit
from .phrases import OP12_SQL, op12_collocations
from .pii import op8_surrogates
from .secrets import OP10_SQL, op10_secrets
from .sharding import op7_shard
from .topk import OP6_SQL, op6_top_products
from .urls import OP11_SQL, op11_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_language_id": op3_language_id,
    "op4_nearest": op4_nearest,
    "op5_mix": op5_mix,
    "op6_top_products": op6_top_products,
    "op7_shard": op7_shard,
    "op8_surrogates": op8_surrogates,
    "op9_best_fit": op9_best_fit,
    "op10_secrets": op10_secrets,
    "op11_url_filter": op11_url_filter,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op5_mix": OP5_SQL, "op6_top_products": OP6_SQL, "op10_secrets": OP10_SQL, "op11_url_filter": OP11_SQL, "op12_collocations": OP12_SQL}
