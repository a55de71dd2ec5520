"""The corpus pipeline: documents to token ids, in stages over operators of tidewatch.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and reread as the next stage's docs. All but the last keep the columns
of documents.

1. toxicity: documents scored 0.5 or more go.
2. line dedup: lines that repeat an earlier line, or differ from one by one
   edit, go; documents of which nothing is left go too.
3. n-gram Jaccard join: one document of each near-duplicate class stays.
4. mixing: every document as often as the source weights ask for.
5. SentencePiece: token ids, with a check that they decode to the text.

No stage can be put in SQL as a whole (training, edit neighbourhoods, sampled
paths, tokeniser merges), so ORACLE_SQL is None; tests compare with brute force.
"""

from __future__ import annotations

from tidewatch.llm import chosen_path, line_dedup, mixing, sentencepiece_fst, toxicity
from tidewatch.llm.common import clear, made_so_far, table, written


def toxicity_stage(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark, docs, sf_dir):
    return line_dedup.without_repeats(docs)


def jaccard_stage(spark, docs, sf_dir):
    return chosen_path.one_of_each(docs)


def mixing_stage(spark, docs, sf_dir):
    return mixing.mix(docs)


def sentencepiece_stage(spark, docs, sf_dir):
    return sentencepiece_fst.encode_texts(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), made_so_far()
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k + 1}")
        # neither the stage's own tables nor its predecessor's result are read again
        clear(spark, before | {docs._scratch})
    return docs
