"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline

from genoframe.llm import filter_audit, html_extract, jaccard_join, line_dedup, media, mixing, quality_rules, sentencepiece_bpe, spelling, subword, warc, word_bpe

QUERIES = {
    "op1_toxicity": subword.op1,
    "op2_warc_fixity": warc.op2,
    "op3_mixing": mixing.op3,
    "op4_media": media.op4,
    "op5_quality_classifier": subword.op5,
    "op6_jaccard_join": jaccard_join.op6,
    "op7_sentencepiece": sentencepiece_bpe.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_html_extract": html_extract.op10,
    "op11_spelling": spelling.op11,
    "op12_word_bpe": word_bpe.op12,
    "op13_filter_audit": filter_audit.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_warc_fixity": warc.SQL,
    "op3_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
