"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from provender.llm import chat, decontaminate, html_extract, lexical, lm_score, mixing, packing, quality, simhash, token_counts, topk, url_filter, whitening
from provender.llm.common import table


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op2_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bin_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts,
    op2_html_extraction,
    op3_simhash,
    op4_lm_scoring,
    op5_url_filter,
    op6_mixing,
    op7_chat_formatting,
    op8_decontamination,
    op9_top_k,
    op10_quality,
    op11_bin_packing,
    op12_whitening,
    op13_lexical_search,
)}

ORACLES = {
    "op6_mixing": mixing.mix_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    "op7_chat_formatting": chat.rotate_sql("conversations"),
    "op9_top_k": topk.top_k_sql("embeddings"),
    "op13_lexical_search": lexical.search_sql("benchmark", "documents"),
}
