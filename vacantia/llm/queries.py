"""Registered queries of this subpackage: one for each operator, with SQL forms where SQL can express them."""

from __future__ import annotations

from vacantia.llm import (html_text, lattice, mixing, neighbours, packing, passages, prefix_trie, pseudonyms, records,
                          spelling, token_groups, toxicity, warc)
from vacantia.llm.common import table
from vacantia.llm.oracles import ORACLES


def op1_toxicity(spark, sf_dir):
    return toxicity.scored_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark, sf_dir):
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.protect(docs, count="n_replaced")


def op4_ngram_jaccard(spark, sf_dir):
    return token_groups.jaccard_classes(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_token_records(spark, sf_dir):
    return records.record_digest(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op7_source_mix(spark, sf_dir):
    return mixing.mixed_digest(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark, sf_dir):
    return neighbours.neighbours_digest(table(spark, sf_dir, "embeddings"))


def op9_packing(spark, sf_dir):
    return packing.packed_digest(table(spark, sf_dir, "documents"))


def op10_html_text(spark, sf_dir):
    return html_text.text_digest(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants_digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark, sf_dir):
    return passages.passages_digest(table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_embedding_near_dedup, op3_pii, op4_ngram_jaccard, op5_token_records, op6_warc, op7_source_mix,
    op8_nearest_neighbours, op9_packing, op10_html_text, op11_spelling_variants, op12_prefix_trie, op13_suffix_dedup)}
