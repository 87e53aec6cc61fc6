"""The registered queries of this subpackage and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from . import bpe, collocations, compaction, conversations, decontaminate, html_text, near_dedup, pii, quality, repeats, url_filter, warc, word_bpe

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op3_url_filter": url_filter.op3_url_filter,
    "op2_compaction": compaction.op2_compaction,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_repeats": repeats.op6_repeats,
    "op7_warc": warc.op7_warc,
    "op8_quality": quality.op8_quality,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_html_text": html_text.op10_html_text,
    "op11_word_bpe": word_bpe.op11_word_bpe,
    "op12_collocations": collocations.op12_collocations,
    "op13_repair": conversations.op13_repair,
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op7_warc": warc.OP7_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_repair": conversations.OP13_SQL,
}
