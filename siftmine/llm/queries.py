"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op1_decontamination
from .embeddings import op3_embedding_range_join
from .embeddings import oracle as op3_sql
from .jaccard import op9_jaccard_join
from .jaccard import oracle as op9_sql
from .language import op2_language_mixture
from .licenses import op6_license_scan
from .licenses import oracle as op6_sql
from .packing import op5_mixture_packing
from .quality import op8_quality_votes
from .secrets import op7_secret_scan
from .simple8b import op10_token_files
from .toxicity import op4_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_mixture": op2_language_mixture,
    "op3_embedding_range_join": op3_embedding_range_join,
    "op4_toxicity": op4_toxicity,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_license_scan": op6_license_scan,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_votes": op8_quality_votes,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {"op3_embedding_range_join": op3_sql(), "op6_license_scan": op6_sql(), "op9_jaccard_join": op9_sql()}
