"""Ranked lexical search over posting blocks.

The index holds a row for each (term, block of documents): positions and counts.
Search deals the postings of the items' terms and the items' terms by term and
part of the blocks and joins them there; document frequencies and weights come
from the postings that met. What was joined is dealt again by group of items and
block: there every match gets its integer score, scores are summed by item and
document (a block's documents and a group's items are few, so the sums are one
small matrix), and the k best of each item go on. A window over these numbers
the k best of all. No row of an index is larger than a block, no sum larger than
a block times a group, whatever a term's frequency.

Score of a term in a document: w * ((10^9 tf) div (1000 tf + 8 m)), where w is
floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L; N documents
with a term, L terms with repeats, n those of the document.

Defined cases: null and empty texts have no terms, neither match nor count in N;
rows are judged each by itself, also those that share a doc_id (a null doc_id
comes after others in ties); items that share an item_id are one item with the
terms of all; an item without a matching term gives no rows; empty tables give
none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written
from .postings import blocks, headed, inverted, lists, numbered_rows, words

TOP, GROUP_ITEMS, BLOCKS_A_PART = 10, 128, 64


def _indexed(batches):
    for first, ids, texts in blocks(batches):
        known, keys = {}, []
        for text in texts:
            keys.append(np.array([known.setdefault(w, len(known)) for w in words(text)], np.int64))
        n = np.array([len(k) for k in keys], np.int32)
        key, begin, docs, counts = inverted(keys, len(known))
        terms = list(known)
        # the block's documents come first, as a row without a term
        docs = np.concatenate([np.arange(len(texts), dtype=np.int32), docs])
        offsets = np.concatenate([[0], begin + len(texts)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key) + 1, first, np.int64)), pa.array([None] + [terms[k] for k in key.tolist()], pa.binary()).cast(pa.string()), lists(offsets, docs), lists(offsets, np.concatenate([n, counts])), headed(ids, len(key) + 1)],
            names=["block", "term", "docs", "counts", "ids"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """Postings (block, term, docs, counts, ids), written; rows without a term hold the block's documents: lengths as counts, and ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(numbered_rows(docs).mapInArrow(_indexed, f"block long, term string, docs array<int>, counts array<int>, ids array<{kind}>"), "lexical-index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("term")).where("term <> ''").distinct()


def _best(scores: np.ndarray, ids: list, items: list, k: int):
    """The k best documents of each row of scores; ties to smaller ids, null last."""
    order = {p: r for r, p in enumerate(sorted(range(len(ids)), key=lambda p: (ids[p] is None, ids[p] if ids[p] is not None else 0)))}
    rank = np.array([order[p] for p in range(len(ids))])
    for row, item in zip(scores, items, strict=True):
        least = max(1, np.partition(row, -k)[-k] if len(row) > k else 1)
        among = np.flatnonzero(row >= least)
        for p in among[np.lexsort((rank[among], -row[among]))][:k].tolist():
            yield item, ids[p], int(row[p])


def _scored(k: int, n_docs: int, n_terms: int, schema: pa.Schema):
    def flush(held):
        if held is not None and held["at"]:
            items = list(held["at"])
            rows = list(_best(held["scores"][: len(items)], held["ids"], items, k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held = None
        for b in batches:
            docs, counts, rest = b.column("docs"), b.column("counts"), b.select(["group", "block", "w", "items", "ids"]).to_pylist()
            for i, r in enumerate(rest):
                count = counts[i].values.to_numpy().astype(np.int64)
                if r["ids"] is not None:  # the documents of the next block
                    yield from flush(held)
                    held = {"ids": r["ids"], "m": 8 * (10 + (90 * count * n_docs) // max(1, n_terms)), "at": {}, "scores": np.zeros((GROUP_ITEMS, len(count)), np.int64), "key": (r["group"], r["block"])}
                    continue
                assert held["key"] == (r["group"], r["block"])
                at, pos = held["at"], docs[i].values.to_numpy()
                mine = [at.setdefault(item, len(at)) for item in r["items"]]
                while len(at) > len(held["scores"]):
                    held["scores"] = np.concatenate([held["scores"], np.zeros_like(held["scores"])])
                held["scores"][np.ix_(mine, pos)] += r["w"] * ((1_000_000_000 * count) // (1000 * count + held["m"][pos]))
        yield from flush(held)

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score (above 0)."""
    spark = index.sparkSession
    asked = written(item_terms(items), "lexical-terms")
    of_docs = index.where("ids is not null")
    n_docs, n_terms, n_blocks = of_docs.agg(F.sum(F.size(F.filter("counts", lambda n: n > 0))), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)), F.count("*")).first()
    n_docs, n_terms, n_items = n_docs or 0, n_terms or 0, asked.select("item_id").distinct().count()
    parts, groups = max(1, -(-n_blocks // BLOCKS_A_PART)), max(1, -(-n_items // GROUP_ITEMS))
    part, every_part = F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    terms = asked.select("term").distinct().select("term", every_part)
    met = written(index.where("term is not null").select("block", "term", "docs", "counts", part).join(terms.hint("shuffle_hash"), ["term", "part"], "left_semi"), "lexical-met")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = met.groupBy("term").agg(F.sum(F.size("docs")).cast("double").alias("df")).select("term", weight.alias("w"))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group")
    # a group's items are about GROUP_ITEMS, so this list is too
    wanted = asked.select("term", "item_id", group).groupBy("term", "group").agg(F.collect_list(F.struct("item_id"))["item_id"].alias("items")).join(weights, "term")
    matches = met.join(wanted.select("*", every_part).hint("shuffle_hash"), ["term", "part"]).select("group", "block", "term", "docs", "counts", "w", "items", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"))
    heads = of_docs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "block", "term", "docs", "counts", F.lit(None).cast("long").alias("w"), F.lit(None).cast(matches.schema["items"].dataType).alias("items"), "ids")
    dealt = heads.unionAll(matches).repartition(shuffle_partitions(spark), "group", "block").sortWithinPartitions("group", "block", F.col("ids").isNull(), "term")
    kinds = [items.schema["item_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()]
    arrow = pa.schema([("item_id", _arrow(kinds[0])), ("doc_id", _arrow(kinds[1])), ("score", pa.int64())])
    best = dealt.mapInArrow(_scored(k, n_docs, n_terms, arrow), f"item_id {kinds[0]}, doc_id {kinds[1]}, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "lexical-best")
    discard(asked, met)
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    index = build_index(docs)
    out = search(index, items)
    discard(index)
    return out


def oracle() -> str:
    terms = lambda t, i: f"select {i}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from {t}"
    return f"""
with doc_terms as (select doc_id, term, count(*) as tf from ({terms("documents", "doc_id")}) group by all),
lengths as (select doc_id, sum(tf)::bigint as n from doc_terms group by doc_id),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
item_terms as (select distinct * from ({terms("benchmark", "item_id")})),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from doc_terms, totals group by term, n_docs),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::bigint as score
  from item_terms join doc_terms using (term) join weights using (term) join lengths using (doc_id), totals group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}"""
