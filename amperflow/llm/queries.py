"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op8_chunk_reuse_bpe
from .decontaminate import ORACLE as DECONTAMINATE
from .decontaminate import op3_containment_decontamination
from .language import op7_recurrent_language
from .lines import ORACLE as LINES
from .lines import op11_perfect_hash_lines
from .merkle import ORACLE as MERKLE
from .merkle import op13_merkle_manifest
from .neardup import ORACLE as NEARDUP
from .neardup import op5_circulant_neardup
from .neighbours import ORACLE as NEIGHBOURS
from .neighbours import op6_descent_search
from .phrases import ORACLE as PHRASES
from .phrases import op12_suffix_collocations
from .pii import op4_boosted_pii
from .secrets import op9_entropy_secrets
from .shards import ORACLE as SHARDS
from .shards import op10_feistel_shards
from .substrings import ORACLE as SUBSTRINGS
from .substrings import op2_suffix_dedup
from .webtext import op1_wrapper_main_text

QUERIES = {
    "op1_wrapper_main_text": op1_wrapper_main_text,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_containment_decontamination": op3_containment_decontamination,
    "op4_boosted_pii": op4_boosted_pii,
    "op5_circulant_neardup": op5_circulant_neardup,
    "op6_descent_search": op6_descent_search,
    "op7_recurrent_language": op7_recurrent_language,
    "op8_chunk_reuse_bpe": op8_chunk_reuse_bpe,
    "op9_entropy_secrets": op9_entropy_secrets,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_perfect_hash_lines": op11_perfect_hash_lines,
    "op12_suffix_collocations": op12_suffix_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The search is approximate, but finds all of a small table: its SQL is an exact search.
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": SUBSTRINGS,
    "op3_containment_decontamination": DECONTAMINATE,
    "op5_circulant_neardup": NEARDUP,
    "op6_descent_search": NEIGHBOURS,
    "op10_feistel_shards": SHARDS,
    "op11_perfect_hash_lines": LINES,
    "op12_suffix_collocations": PHRASES,
    "op13_merkle_manifest": MERKLE,
}
