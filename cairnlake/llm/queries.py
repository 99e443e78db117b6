"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .chat import op5_chat
from .decontaminate import op9_decontamination
from .langid import op10_langid
from .line_dedup import MIN_WORDS, op4_line_dedup
from .ngram_join import op7_ngram_join
from .oracles import CHAT, LINE_DEDUP, NGRAM_JOIN, PII, QUALITY, SHARDING
from .pii import IBAN_LENGTHS, op1_pii
from .quality import MARKS, STOP_WORDS, op6_quality
from .sharding import op8_sharding
from .token_counts import op2_token_counts

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_langid": op10_langid,
}

ORACLES = {
    "op1_pii": PII.replace("{ibans}", " ".join(IBAN_LENGTHS)),
    "op4_line_dedup": LINE_DEDUP.replace("{words}", str(MIN_WORDS)),
    "op5_chat": CHAT,
    "op6_quality": QUALITY.replace("{stop}", " ".join(sorted(set(STOP_WORDS)))).replace("{marks}", MARKS.replace("'", "''")),
    "op7_ngram_join": NGRAM_JOIN,
    "op8_sharding": SHARDING,
}
