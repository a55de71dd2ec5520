"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import ann, chosen_path, html_mincut, lexical, line_dedup, media, mixing, pii, resample, sentencepiece_fst, simhash, toxicity, warc
from .common import table


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.encode_texts(table(spark, sf_dir, "documents"))


def op2_media_columns(spark, sf_dir):
    return media.text_media_report(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark, sf_dir):
    return ann.search_report(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark, sf_dir):
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_chosen_path_join(spark, sf_dir):
    return chosen_path.classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark, sf_dir):
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark, sf_dir):
    return lexical.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_sentencepiece, op2_media_columns, op3_mix_sources, op4_nearest_neighbours, op5_html_extraction, op6_line_dedup, op7_chosen_path_join, op8_toxicity, op9_pii, op10_warc, op11_lexical_search, op12_importance_resampling, op13_simhash)}


def oracle_sql():
    return {"op3_mix_sources": mixing.oracle(), "op4_nearest_neighbours": ann.oracle(), "op10_warc": warc.ORACLE, "op11_lexical_search": lexical.oracle(), "op12_importance_resampling": resample.oracle()}
