"""The corpus operators' queries and the SQL they are checked against."""

from . import op1_quality, op2_tokens, op3_suffixes, op4_jaccard, op5_paragraphs, op6_language, op7_packing, op8_html, op9_warc, op10_decontaminate, op11_pii, op12_conversations, op13_variants  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
