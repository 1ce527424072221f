"""The operators' queries and SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from .ann import op1_hnsw
from .hilbert_sharding import OP2_SQL, op2_hilbert_sharding
from .language_id import op10_language_id
from .media import op4_iso_media
from .mixing import OP5_SQL, op5_hash_threshold_mix
from .ngram_jaccard import OP6_SQL, op6_ngram_jaccard
from .packing import op7_config_lp_packing
from .substring_dedup import OP9_SQL, op9_rabin_karp_dedup
from .suffix_dedup import OP8_SQL, op8_suffix_dedup
from .toxicity import op3_toxicity_chain

QUERIES = {
    f.__name__: f
    for f in (
        op1_hnsw,
        op2_hilbert_sharding,
        op3_toxicity_chain,
        op4_iso_media,
        op5_hash_threshold_mix,
        op6_ngram_jaccard,
        op7_config_lp_packing,
        op8_suffix_dedup,
        op9_rabin_karp_dedup,
        op10_language_id,
    )
}
ORACLE_SQL = {"op2_hilbert_sharding": OP2_SQL, "op5_hash_threshold_mix": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op9_rabin_karp_dedup": OP9_SQL}
