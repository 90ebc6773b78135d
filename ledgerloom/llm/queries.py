"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .centroid_clusters import op12_centroid_clusters
from .embedding_dedup import op9_embedding_dedup
from .language_id import op1_language_id
from .mixing import op2_mixing
from .ngram_join import op5_ngram_jaccard_join
from .packing import op13_best_fit_packing
from .pii import op3_pii
from .quality import op8_quality
from .substring_dedup import op7_substring_dedup
from .token_files import op10_token_files
from .transport_stream import op6_transport_stream
from .vector_codes import op11_vector_codes

QUERIES = [op1_language_id, op2_mixing, op3_pii, op4_bpe, op5_ngram_jaccard_join, op6_transport_stream, op7_substring_dedup, op8_quality, op9_embedding_dedup, op10_token_files, op11_vector_codes, op12_centroid_clusters, op13_best_fit_packing]

ORACLE_SQL: dict[str, str] = {}


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
