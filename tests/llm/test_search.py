import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import SF
from pyspark.sql import functions as F

from tidewatch.llm import lexical, postings, queries, resample, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOOSE = "lorem ipsum Dolor sit amet été straße 42 naïve Ünder 東京 x_y co-op 😀 end.".split(" ")
EXTRA = ("block", "term", "docs", "counts", "ids", "part", "group", "items", "w", "key", "fp", "salt", "root", "rank", "total", "pos", "bucket", "_row", "_rank", "item")


def texts(seed: int, n: int) -> list[str | None]:
    r = random.Random(seed)
    made = [" ".join(r.choice(LOOSE) for _ in range(r.randrange(60))) for _ in range(n)]
    return [None, "", " \t\n", "...", "one", "the\x00zero byte", "Long " * 30_000, "y" * 200_000, *made, *made[:5]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts(1, 150))]
    rows += [(None, "lorem ipsum dolor", "en", None, 1), (None, "lorem ipsum dolor", "en", None, 1), (3, "dolor sit amet dolor", None, "b", 2), (3, "dolor sit amet dolor", None, "b", 2)]
    return spark.createDataFrame(rows, DOC).repartition(3, "doc_id").sortWithinPartitions("doc_id", "text").withColumns({c: F.lit(1) for c in EXTRA})


def listed(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.collect()]


# postings -------------------------------------------------------------------


def test_words_are_the_contracts():
    for t in filter(None, texts(2, 80)):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert [w.decode() for w in postings.words(t.encode())] == want


def test_inverted_lists_hold_every_count():
    r = random.Random(3)
    keys = [np.array([r.randrange(9) for _ in range(r.randrange(20))], np.int64) for _ in range(40)]
    key, begin, docs, counts = postings.inverted(keys, 9)
    got = {(k, int(d)): int(c) for k, a, b in zip(key.tolist(), begin, begin[1:], strict=False) for d, c in zip(docs[a:b], counts[a:b], strict=True)}
    assert got == {(k, i): c for i, ks in enumerate(keys) for k, c in Counter(ks.tolist()).items()}
    assert [len(x) for x in postings.inverted([], 5)] == [0, 1, 0, 0]


def test_blocks_end_by_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "BLOCK_DOCS", 3)
    monkeypatch.setattr(postings, "BLOCK_BYTES", 10)
    b = pa.RecordBatch.from_pydict({"_row": list(range(8)), "doc_id": list(range(8)), "text": [b"x" * 30, None, b"", b"ab", b"c" * 9, b"d", b"e", b"f"]})
    got = [(first, ids.to_pylist(), [len(t) for t in ts]) for first, ids, ts in postings.blocks([b])]
    assert [i for _, ids, _ in got for i in ids] == list(range(8)) and all(first == ids[0] for first, ids, _ in got)
    assert got[0][1] == [0] and all(len(ids) == 1 or sum(s) <= 10 and len(ids) <= 3 for _, ids, s in got)


# 11 -------------------------------------------------------------------------


def searched(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    terms = lambda t: [w.decode() for w in postings.words((t or "").encode())]
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        rows = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in ts if t in b)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


ITEMS = [(0, "Lorem DOLOR été"), (1, None), (2, ""), (3, "nothing-matches qqq"), (4, "naïve 42 x y co op end"), (4, "tokyo 東京"), (None, "sit amet"), (7, " ".join(LOOSE) + " long one zero")]


@pytest.mark.parametrize("block, group", [(2048, 128), (7, 2)])
def test_search_equals_scoring_all(spark, docs, monkeypatch, block, group):
    monkeypatch.setattr(lexical, "GROUP_ITEMS", group)
    monkeypatch.setattr(lexical, "BLOCKS_A_PART", 2)
    monkeypatch.setattr(postings, "BLOCK_DOCS", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = sorted([tuple(r) for r in lexical.search_report(docs, items).select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert got == searched(listed(docs), ITEMS, 10)


def test_search_of_nothing(docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search_report(docs.limit(0), items).count() == 0
    assert lexical.search_report(docs, items.limit(0)).count() == 0


# 12 -------------------------------------------------------------------------


def resampled(docs: list[tuple], targets: list[str | None], share: int, least: int) -> list[tuple]:
    def feats(t):
        w = [x.decode() for x in postings.words((t or "").encode())]
        return w, Counter(zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])

    all_f, want = [feats(t) for _, t in docs], sum((feats(t)[1] for t in targets), Counter())
    s = sum((f for _, f in all_f), Counter())
    big_s, big_t = sum(s.values()), sum(want.values())
    rows = []
    for (i, _), (w, f) in zip(docs, all_f, strict=True):
        n = sum(f.values())
        gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
        weight = sum(c * gain(b) for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    drawn = share * sum(r[4] >= least for r in rows) // 100
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    # equal documents may change places, so ranks are held against sorted scores
    return sorted([r[:4] for r in rows], key=str), [(k + 1, r[0], r[3]) for k, r in enumerate(order[:drawn])]


@pytest.mark.parametrize("block", [2048, 5])
def test_resampling_equals_plain_counts(spark, docs, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK_DOCS", block)
    monkeypatch.setattr(resample, "BLOCKS_A_PART", 2)
    targets = ["lorem ipsum", None, "", "sit amet été Long long", "東京 naïve"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = resample.resample(docs, items).collect()
    rows, drawn = resampled(listed(docs), targets, 25, 20)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score) for r in got], key=str) == rows
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None) == drawn and drawn
    kept = resample.draw(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for _, i, _ in drawn}


def test_resampling_of_nothing(docs, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.resample(docs.limit(0), items).count() == 0
    assert [r.weight for r in resample.resample(docs, items.limit(0)).collect()] != []


def test_bucket_checksums_continue():
    w = ["ab", "c", "ab", "é"]
    assert resample.buckets([x.encode() for x in w]).tolist() == [zlib.crc32(f.encode()) % 10_000 for f in [*w, "ab c", "c ab", "ab é"]]


def test_ranks_number_all_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), "id")
    got, _ = resample.ranked(df, [F.desc("a"), F.asc("id")], "r")
    rows = sorted((r.r, -r.a, r.id) for r in got.collect())
    assert [r[0] for r in rows] == list(range(1, 501)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


# 13 -------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps: list[int]) -> list[int]:
    """Index of the smallest member reachable."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_plain_ones():
    for t in texts(5, 60):
        assert int(simhash.fingerprint((t or "").encode())) == plain_fingerprint(t)


def ball(seed: int, n: int, centres: int, most: int = 9) -> list[int]:
    r = random.Random(seed)
    around = [r.getrandbits(64) for _ in range(centres)]
    out = set(around)
    while len(out) < n:
        x = r.choice(around)
        for b in r.sample(range(64), r.randrange(most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("n, centres", [(1, 1), (64, 2), (65, 1), (700, 5), (900, 300)])
def test_slices_find_every_link(n, centres):
    fps = ball(n, n, centres)
    a, b = simhash.star_edges(np.zeros(n, np.int64), np.array(fps, np.uint64))
    want = classes(fps)
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [fps.index(got.get(f, f)) for f in fps] == want


def test_slices_keep_buckets_apart():
    fps, keys = np.array([0, 1, 3, 0, 7, 1 << 40, 5, 4], np.uint64), np.array([1, 1, 1, 2, 2, 2, 3, 3])
    a, b = simhash.star_edges(keys, fps)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (3, 0), (4, 5), (7, 0), (1 << 40, 0)]


@pytest.mark.parametrize("bucket, large, chunk", [(4096, 65536, 2048), (8, 100_000, 30), (8, 8, 8), (20, 60, 10)])
def test_every_way_finds_all_links(spark, monkeypatch, bucket, large, chunk):
    for name, v in (("BUCKET", bucket), ("LARGE", large), ("CHUNK", chunk)):
        monkeypatch.setattr(simhash, name, v)
    fps = ball(7, 400, 12, 7)
    edges, _ = simhash.links(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"))
    label = {f: f for f in fps}
    pairs = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in edges.collect()]
    assert all(a in label and b in label for a, b in pairs)
    while True:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    assert [fps.index(label[f]) for f in fps] == classes(fps)


def test_bands_share_out_all_bits():
    for mask in ((1 << 64) - 1, 0x0F0F0F0F0F0F0F0F, 0b111, 0):
        parts = simhash.bands(mask)
        assert len(parts) == 5 and sum(parts) == mask and all(a & b == 0 for i, a in enumerate(parts) for b in parts[:i])


def test_classes_equal_comparing_all(spark, docs):
    r = random.Random(9)
    base = [" ".join(r.choice(LOOSE) + str(r.randrange(50)) for _ in range(150)) for _ in range(20)]
    rows = [(i, t, None, None, None) for i, t in enumerate(base + [t.replace("lorem", "LOREM", 1) + " tail" for t in base] + base[:4])]
    given = docs.unionByName(spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in EXTRA}))
    source = listed(given)
    fps = [plain_fingerprint(t) for _, t in source]
    roots, least = classes(fps), {}
    for (i, _), c in zip(source, roots, strict=True):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    want = sorted([(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(source, fps, roots, strict=True)], key=str)
    assert sorted([tuple(x) for x in simhash.near_duplicates(given).select("doc_id", "fingerprint", "component_id").collect()], key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_registered_simhash_equals_comparing_all(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, classes(fps), strict=True)}
    assert {tuple(r) for r in queries.op13_simhash(spark, SF).collect()} == want
