import sentencepiece
from compare import SF
from test_operators import DOC, ODD, brute_classes, brute_lines

import corpus_pipeline
from tidewatch.llm import mixing, sentencepiece_fst
from tidewatch.llm.common import written


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, library = docs.columns, sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        got = written(stage(spark, docs, SF), "stage")
        after = got.collect()
        if name == "toxicity":
            assert all(before[r.doc_id] == r.asDict() for r in after) and len(after) > 0.8 * len(before)
        elif name == "line dedup":
            want = brute_lines([(i, d["text"]) for i, d in before.items()])
            want = {i: t for i, t in want.items() if t.strip() or t == before[i]["text"]}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name.startswith("n-gram"):
            stay = {int(c) for _, c, _ in brute_classes([(i, d["text"]) for i, d in before.items()])}
            assert {r.doc_id for r in after} == stay and all(before[r.doc_id] == r.asDict() for r in after)
        elif name.startswith("mixing"):
            copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
            found = [r.doc_id for r in after]
            assert all(found.count(i) == n for i, n in copies.items()) and all(before[r.doc_id] == r.asDict() for r in after)
        else:
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in docs.collect())
            assert all(r.exact and r.ids == library.encode(before[r.doc_id]["text"]) for r in after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == columns
        docs = got


def test_odd_rows_pass_every_stage(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    docs, got = spark.createDataFrame(ODD, DOC), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "odd")
        got[name.split()[0]] = docs.collect()
    # nothing is toxic, no line repeats another document's; a null text has no characters
    assert order(got["toxicity"]) == order(ODD)
    assert order((r[0], r[1], r[2], r[3], 0 if r[1] is None else r[4]) for r in ODD) == order(got["line"])
    # null and empty texts are one class, equal rows another; of each the smallest id stays
    kept = got["n-gram"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 7), (False, 8), (True, 0)]
    assert set(map(tuple, kept)) <= set(map(tuple, got["line"]))
    # the mix repeats whole rows, at most three times
    mixed = [tuple(r) for r in got["mixing"]]
    assert set(mixed) <= set(map(tuple, kept)) and max(mixed.count(r) for r in mixed) <= 3
    texts = {r.doc_id: r.text or "" for r in kept}
    assert order([r.doc_id] for r in got["SentencePiece"]) == order([r[0]] for r in mixed)
    assert all(r.exact and r.ids == library.encode(texts[r.doc_id]) for r in got["SentencePiece"])
    docs = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "none")
    assert docs.count() == 0
