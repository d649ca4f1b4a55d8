"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import ORACLE_OP13, op13_centroids
from .decontam import ORACLE_OP5, op5_decontaminate
from .langid import op3_language
from .media_avi import op8_media
from .minhash import ORACLE_OP11, op11_minhash
from .piece_dropout import op2_pieces
from .sharding import op1_shards
from .simhash import op7_near_dup
from .suffix_dedup import ORACLE_OP10, op10_repeats
from .token_align import op12_alignment
from .token_store import op4_tokens
from .toxicity import op9_toxicity
from .url_filter import op6_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards,
    "op2_pieces": op2_pieces,
    "op3_language": op3_language,
    "op4_tokens": op4_tokens,
    "op5_decontaminate": op5_decontaminate,
    "op6_urls": op6_urls,
    "op7_near_dup": op7_near_dup,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_repeats": op10_repeats,
    "op11_minhash": op11_minhash,
    "op12_alignment": op12_alignment,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = {
    "op5_decontaminate": ORACLE_OP5,
    "op10_repeats": ORACLE_OP10,
    "op11_minhash": ORACLE_OP11,
    "op13_centroids": ORACLE_OP13,
}
