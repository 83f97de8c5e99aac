"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op12_byte_bpe
from .mixing import op8_mixing
from .packing import op2_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op9_quality
from .scoring import op6_lm_scoring
from .secrets import op3_secret_scans
from .simhash import op5_simhash
from .substrings import OP10_SQL, op10_substrings
from .token_counts import op7_token_counts
from .token_files import op1_token_files
from .winnowing import op4_fingerprints

QUERIES = {f.__name__: f for f in (op1_token_files, op2_packing, op3_secret_scans, op4_fingerprints, op5_simhash, op6_lm_scoring, op7_token_counts, op8_mixing, op9_quality, op10_substrings, op11_prefix_trie, op12_byte_bpe)}
ORACLE_SQL = {"op10_substrings": OP10_SQL, "op11_prefix_trie": OP11_SQL}
