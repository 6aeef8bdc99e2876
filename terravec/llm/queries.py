"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from terravec.llm.chat import op8_chat
from terravec.llm.codes import OP13_SQL, op13_codes
from terravec.llm.embed_dedup import OP5_SQL, op5_embedding_dedup
from terravec.llm.html_text import op9_html
from terravec.llm.langid import op3_langid
from terravec.llm.line_dedup import OP1_SQL, op1_line_dedup
from terravec.llm.nearest import OP11_SQL, op11_nearest
from terravec.llm.negatives import OP12_SQL, op12_negatives
from terravec.llm.packing import op4_packing
from terravec.llm.pieces import op10_sentencepiece
from terravec.llm.quality import OP6_SQL, op6_quality
from terravec.llm.simhash import op7_simhash
from terravec.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_langid": op3_langid,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_html": op9_html,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_nearest": op11_nearest,
    "op12_negatives": op12_negatives,
    "op13_codes": op13_codes,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op6_quality": OP6_SQL,
    "op11_nearest": OP11_SQL,
    "op12_negatives": OP12_SQL,
    "op13_codes": OP13_SQL,
}
