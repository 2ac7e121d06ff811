"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .decontaminate import op5_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard_join import op1_jaccard_join
from .language_id import op2_language_id
from .line_dedup import op10_line_dedup
from .manifest import OP13_SQL, op13_merkle_manifest
from .mixing import op4_mix_sources
from .packing import op12_best_fit_packing
from .phrases import OP11_SQL, op11_phrases
from .substring_dedup import op3_substring_dedup
from .token_counts import op9_token_counts
from .warc import OP7_SQL, op7_warc


def queries() -> dict:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_language_id": op2_language_id,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_mix_sources": op4_mix_sources,
        "op5_decontaminate": op5_decontaminate,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_warc": op7_warc,
        "op8_chat_format": op8_chat_format,
        "op9_token_counts": op9_token_counts,
        "op10_line_dedup": op10_line_dedup,
        "op11_phrases": op11_phrases,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": OP6_SQL,
        "op7_warc": OP7_SQL,
        "op8_chat_format": OP8_SQL,
        "op11_phrases": OP11_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
