"""Operators for training-data corpora; nothing else in the library imports this package."""

from __future__ import annotations

from .knn_join import ORACLE as TOPK_SQL
from .knn_join import op5_topk
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import op8_line_dedup
from .minhash_dedup import op1_minhash
from .pii_tagger import op3_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op4_quality_rules
from .secret_scan import op7_secret_scan
from .sentencepiece_fst import op9_sentencepiece
from .source_mixing import op2_source_mixing
from .toxicity import op6_toxicity

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_source_mixing": op2_source_mixing,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL = {"op5_topk": TOPK_SQL, "op8_line_dedup": LINE_DEDUP_SQL}
