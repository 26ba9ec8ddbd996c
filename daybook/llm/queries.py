"""Queries of this subpackage, with their SQL where SQL can express them."""

from daybook.llm.collocations import PHRASES_SQL, op12_collocations
from daybook.llm.html_text import op4_html_text
from daybook.llm.line_dedup import op10_line_dedup
from daybook.llm.negatives import NEGATIVES_SQL, op11_negatives
from daybook.llm.ngram_join import op3_ngram_join
from daybook.llm.packing import op8_packing
from daybook.llm.pieces import op7_pieces
from daybook.llm.resharding import op13_resharding
from daybook.llm.token_ledger import op2_token_counts
from daybook.llm.topk import TOPK_SQL, op9_topk
from daybook.llm.toxicity import op6_toxicity
from daybook.llm.vector_dedup import op5_vector_dedup
from daybook.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": op3_ngram_join,
    "op4_html_text": op4_html_text,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_topk": op9_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_negatives": op11_negatives,
    "op12_collocations": op12_collocations,
    "op13_resharding": op13_resharding,
}

ORACLES = {
    "op9_topk": TOPK_SQL,
    "op11_negatives": NEGATIVES_SQL,
    "op12_collocations": PHRASES_SQL,
}
