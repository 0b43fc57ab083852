"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from ledgerline.llm.bpe import op9_bpe
from ledgerline.llm.chat import OP7_SQL, op7_chat
from ledgerline.llm.covertree import OP12_SQL, op12_covertree
from ledgerline.llm.decontaminate import op2_decontaminate
from ledgerline.llm.jaccard import OP4_SQL, op4_jaccard
from ledgerline.llm.quality import op8_quality
from ledgerline.llm.secrets import op1_secrets
from ledgerline.llm.sharding import OP3_SQL, op3_sharding
from ledgerline.llm.suffixes import op10_suffixes
from ledgerline.llm.tiff import op5_media
from ledgerline.llm.toxicity import op11_toxicity
from ledgerline.llm.unit_dedup import op6_unit_dedup
from ledgerline.llm.variants import OP13_SQL, op13_variants

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_jaccard": op4_jaccard,
    "op5_media": op5_media,
    "op6_unit_dedup": op6_unit_dedup,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_suffixes": op10_suffixes,
    "op11_toxicity": op11_toxicity,
    "op12_covertree": op12_covertree,
    "op13_variants": op13_variants,
}
ORACLE_SQL = {"op3_sharding": OP3_SQL, "op4_jaccard": OP4_SQL, "op7_chat": OP7_SQL, "op12_covertree": OP12_SQL, "op13_variants": OP13_SQL}
