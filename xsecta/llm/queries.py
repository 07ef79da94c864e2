"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, chosenpath, conversations, jaccard, mixing, mtree, pii, quality, resample, secrets, suffix, urls

QUERIES = {
    "op1_pii": pii.op1_query,
    "op2_bpe": bpe.op2_query,
    "op3_nn_descent": ann.op3_query,
    "op4_mtree": mtree.op4_query,
    "op5_mixing": mixing.op5_query,
    "op6_secrets": secrets.op6_query,
    "op7_url_filter": urls.op7_query,
    "op8_ngram_jaccard": jaccard.op8_query,
    "op9_suffix_dedup": suffix.op9_query,
    "op10_quality": quality.op10_query,
    "op11_importance": resample.op11_query,
    "op12_chosen_path": chosenpath.op12_query,
    "op13_conversations": conversations.op13_query,
}
ORACLE_SQL = {
    "op4_mtree": mtree.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op11_importance": resample.OP11_SQL,
    "op12_chosen_path": chosenpath.OP12_SQL,
    "op13_conversations": conversations.OP13_SQL,
}
