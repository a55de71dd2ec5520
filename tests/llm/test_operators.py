import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from compare import SF, duck, rows
from pyspark.sql import functions as F

from tidewatch.llm import ann, chosen_path, common, html_mincut, line_dedup, media, mixing, pii, queries, sentencepiece_fst, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words here and there", "en", "a", 26), (3, "plain words here and there", "en", "a", 26), (None, "no id at all", "en", None, 12), (7, "x" * 60_000, "en", "b", 60_000), (8, "many words " * 9_000, "fr", "b", 99_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names operators use inside."""
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit(1) for c in ("size", "taken", "ids", "key", "n", "sid", "line", "score", "_size", "target")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck(queries.oracle_sql()[name])
    assert rows(got) == rows(want) and len(got) > 0


# 1 --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)


def test_transducer_equals_the_library(library):
    t, r = sentencepiece_fst.Transducer(sentencepiece_fst.read_model()), random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice("ab e▁ \n\té☃𐍈the 0123.,()<s>") for _ in range(r.randrange(40)))
        ids = t.encode(text)
        assert ids.tolist() == library.encode(text)
        assert t.decode(ids) == library.decode(ids.tolist())
    assert t.encode("x" * 30_000).tolist() == library.encode("x" * 30_000)


def test_decided_pairs_outlive_a_task_and_segments_do_not():
    t = sentencepiece_fst.Transducer(sentencepiece_fst.read_model())
    first = t.encode("pairs of pieces are decided once")
    known = dict(t.pairs)
    t.forget()
    assert known and t.pairs == known and not t.young and not t.old
    assert t.encode("pairs of pieces are decided once").tolist() == first.tolist() and t.pairs == known


def test_unigram_models_take_the_lightest_path():
    """A hand-made model: pieces a, b, ab with ab lighter than a b."""
    import struct

    def field(n, v):
        if isinstance(v, int):
            return bytes([n << 3, v])
        if isinstance(v, float):
            return bytes([n << 3 | 5]) + struct.pack("<f", v)
        return bytes([n << 3 | 2, len(v)]) + v

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("abb", -9.0, 1)]
    model = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces) + field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0))
    t = sentencepiece_fst.Transducer(model)
    assert [t.text[i] for i in t.encode("abb").tolist()] == ["▁", "ab", "b"]
    assert t.encode("☃").tolist() == [1, 0]


def test_encoding_and_decoding_frames(spark, odd, none, library):
    got = sentencepiece_fst.encode_texts(odd)
    found = [(r.doc_id, r.n_tokens, r.ids, r.exact) for r in got.collect()]
    assert sorted(map(str, ((i, len(x := library.encode(t or "")), x, True) for i, t, *_ in ODD))) == sorted(map(str, found))
    assert sorted(map(str, [(r.doc_id, r.text) for r in sentencepiece_fst.decode_ids(got).collect()])) == sorted(map(str, [(i, t or "") for i, t, *_ in ODD]))
    assert sentencepiece_fst.encode_texts(none).count() == 0


# 2 --------------------------------------------------------------------------


def test_media_report_on_every_case(odd, none):
    got = sorted(media.text_media_report(odd).collect(), key=str)
    assert len(got) == len(ODD)
    for r in got:
        text = {(i, len((t or "").encode())): t for i, t, *_ in ODD}[r.doc_id, r.n_bytes]
        payload = media.pad((text or "").encode())
        stored = media.encode_png(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(payload) % 192 == 0 < len(payload)
        assert media.decode_png(stored) == (64, len(payload) // 192, payload)
    assert media.text_media_report(none).count() == 0


def plain_feature(samples):
    """Size, mean, deviation, entropy and difference hash with plain numbers, rows of 64 pixels."""
    height = len(samples) // 192
    mean = sum(samples) / len(samples)
    dev = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
    shares = [samples.count(x) / len(samples) for x in set(samples)]
    grey = [[sum(samples[192 * y + 3 * x : 192 * y + 3 * x + 3]) for x in range(64)] for y in range(height)]
    edges, bits = [k * 64 // 9 for k in range(10)], ""
    for k in range(8):
        row = grey[k * height // 8]
        cells = [sum(row[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        bits += "".join("1" if b > a else "0" for a, b in zip(cells, cells[1:], strict=False))
    return 64, height, mean, dev, -sum(p * math.log2(p) for p in shares), int(bits, 2)


def test_images_and_features_equal_a_plain_reading(spark):
    r = random.Random(4)
    texts = ["", "a", "one two three " * 30, "".join(chr(r.randrange(32, 1000)) for _ in range(3000)), "\u00e9" * 96]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {x.doc_id: bytes(x.media) for x in media.store_texts(docs).collect()}
    for got in media.text_media_report(docs).collect():
        image, data = stored[got.doc_id], texts[got.doc_id].encode()
        at = image.index(b"IDAT")
        raw = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")])
        assert image[:8] == b"\x89PNG\r\n\x1a\n" and image[-8:-4] == b"IEND" and int.from_bytes(image[16:20], "big") == 64
        samples = b"".join(raw[i + 1 : i + 193] for i in range(0, len(raw), 193))
        assert samples == data.ljust(-(-max(len(data), 1) // 192) * 192) and got.payload_sha256 == hashlib.sha256(samples).hexdigest()
        m = re.fullmatch(r"(\d+)x(\d+);mean=([\d.]+);dev=([\d.]+);entropy=(-?[\d.]+);dhash=([0-9a-f]{16})", got.feature)
        width, height, mean, dev, entropy, bits = plain_feature(samples)
        assert (int(m[1]), int(m[2]), int(m[6], 16)) == (width, height, bits)
        assert all(abs(float(m[k]) - x) < 1e-4 for k, x in ((3, mean), (4, dev), (5, entropy)))


def test_sequences_keep_order_positions_and_captions(spark):
    a, b = media.encode_png(b"a" * 192), media.encode_png(b"b" * 384)
    da, db = (hashlib.sha256(x).hexdigest() for x in (a, b))
    page = f'<p>one</p><figure><img src="sha256:{da}"><figcaption>cap A</figcaption></figure>two<img alt="B" src="urn:sha256:{db}"><script>no</script><p>three<img src="sha256:{"0" * 64}">'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    store = spark.createDataFrame([(da, a), (db, b), (db, b)], "digest string, media binary")
    items = media.interleave(pages, media.describe_store(store), "id").orderBy("pos").collect()
    assert [(r.pos, r.kind, r.text, r.caption, r.resolved, r.payload_bytes) for r in items] == [(0, "text", "one", None, False, None), (1, "img", None, "cap A", True, 192), (2, "text", "two", None, False, None), (3, "img", None, "B", True, 384), (4, "text", "three", None, False, None), (5, "img", None, None, False, None)]
    together = media.sequences(media.interleave(pages, media.describe_store(store), "id"), "id").collect()
    assert [len(r["items"]) for r in together] == [6]


# 3 --------------------------------------------------------------------------


def test_mix_targets_and_repeats(spark, odd, none):
    docs = [(i, "w " * (1 + i % 9), "en", None if i % 11 == 0 else f"s{i % 4}", 1) for i in range(800)]
    df = spark.createDataFrame(docs, DOC)
    got = mixing.mix_report(df).toPandas()
    total = got["size"].sum()
    by = got.assign(source=[docs[i][3] for i in got.doc_id]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(by.target.sum() - total) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all() and (abs(by.taken - by.target) <= 9).all()
    assert (got.taken <= 3 * got["size"]).all()
    assert rows(got) == rows(mixing.mix_report(df.repartition(7)).toPandas())
    again = mixing.mix(odd)
    assert again.columns == odd.columns and again.count() == mixing.mix_report(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    same = spark.createDataFrame([(1, f"w{k}", "en", "a", 1) for k in range(40)] + [(2, "w " * 40, "en", "b", 1)], DOC)
    assert sorted(map(str, mixing.mix(same).collect())) == sorted(map(str, mixing.mix(same.repartition(5)).collect()))
    assert mixing.salts_for(10**6) == 64 and mixing.salts_for(10**11) * mixing.PER_SALT >= 10**11


def test_mix_needs_no_python(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4 --------------------------------------------------------------------------


def test_search_is_exact_with_ties_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16)).round(2)
    x[100:160] = x[0]
    x[200] = x[0] * 5
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, [0.0] * 16), (600, [float("nan")] * 16), (650, [None] * 16), (700, [1.0, 2.0]), (None, [1.0] * 16), (50, x[1].tolist())]
    data += [(i, [c * 1e200 for c in x[i].tolist()]) for i in (60,)] + [(800, [1e200, *[1.0] * 15]), (850, [5e-324] * 16), (900, [1e-200, *[0.0] * 15]), (0, x[0].tolist()), (0, x[3].tolist()), (101, x[101].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("h", "v", "n", "copies", "dim", "rank")})
    v = ann.usable(df)
    got = ann.nearest(v, v.where("vec_id % 50 = 0"), 5, 2, 64).toPandas()
    want = []
    ok = [(i, np.array(v)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for at, (q, qv) in enumerate(ok):
        c = [(i, v) for k, (i, v) in enumerate(ok) if k != at and len(v) == len(qv)]
        if q % 50 == 0 and c:
            s = ann.cosines(np.array([qv] * len(c)), np.array([v for _, v in c]))
            assert np.isfinite(s).all()
            want += [(q, k + 1, i, -a) for k, (a, i) in enumerate(sorted(zip((-s).tolist(), [i for i, _ in c], strict=True))[:5])]
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == sorted(want)
    assert ann.search_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_long_vectors_have_exact_bounds(spark):
    x = np.random.default_rng(5).normal(size=(120, 3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search_report(df).orderBy("query_id", "rank").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        assert [r.vec_id for r in got if r.query_id == q] == [int(i) for i in np.argsort(-(unit @ unit[q])) if i != q][:5]


def test_blocks_are_not_copied_and_tasks_give_k_rows_a_query(spark):
    x = np.random.default_rng(6).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    v = ann.usable(df)
    q = v.where("vec_id % 20 = 0")
    # 100 blocks of candidates in one share, 10 of queries
    plan = ann.nearest(v, q, 5, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1
    got = ann.tiles(v, q, 5, 2, 4).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 400, 20):
        assert got[got.query_id == i].sort_values("score", ascending=False).vec_id.tolist() == [int(j) for j in np.argsort(-(unit @ unit[i])) if j != i][:5]
    assert len(got) == 20 * 5


def test_blocks_are_bounded_in_bytes_and_keep_narrow_components(spark):
    x = np.random.default_rng(7).normal(size=(900, 2000)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    got = ann.blocks(ann.usable(df), 8192).collect()
    assert sum(r.n for r in got) == 900 and max(len(r.vectors) + len(r.codes) for r in got) <= ann.BLOCK_BYTES
    assert all(np.array_equal(np.frombuffer(r.vectors, np.float32).reshape(r.n, -1), x[np.frombuffer(r.ids, np.int64)]) for r in got)


# 5 --------------------------------------------------------------------------

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>The best site about things in the world.</p></header><div class="cookie-notice">We use cookies to give you the best experience. Accept them now please.</div>
<article class="post"><h1>Title &amp; more</h1><p>First paragraph of the article, it says many things&nbsp;about the world.</p><p>Short.</p><aside>Related: read this other long article.</aside><div class="advert">Buy our great product now, it is cheap.</div>
<ul><li>point one of list<li>point two</ul><p>End &#169; of it<br>with a break.</p></article><section id="comments"><div class="comment"><p>I think this article is great and I want to say many things about it.</p></div><form><label>Name</label></form></section>
<footer><p>All rights reserved, and a long legal text here that no one reads.</p></footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_extraction_of_a_page_and_of_the_tables_pages(spark):
    text = "Title & more\nFirst paragraph of the article, it says many things about the world.\nShort.\npoint one of list\npoint two\nEnd © of it with a break."
    got = html_mincut.extract(spark.createDataFrame([(1, "u", PAGE, 3), (2, "v", None, 3), (3, None, "", 3), (None, "w", PAGE, 3)], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", text, len(text)), ("2", "", 0), ("3", "", 0), ("None", text, len(text))])
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, p in zip(html_mincut.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|h2)\b[^>]*>", inner))
        assert r.text == "\n".join(x for x in parts if x)


def test_max_flow_equals_brute_force_cuts():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(1, 7)
        tie = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]
        g = html_mincut.Flow(n + 2)
        for k, t in enumerate(tie):
            g.arc(*((n, k) if t > 0 else (k, n + 1)), abs(t))
        for i, j, w in edges:
            g.arc(i, j, w, w)
        level = g.run(n, n + 1)
        cost = lambda side: sum(abs(t) for k, t in enumerate(tie) if (t > 0) != side[k]) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost([level[k] >= 0 for k in range(n)]) - best) < 1e-6


def test_hidden_parts_of_blocks_and_titles_about_hidden_things():
    prose = "A long paragraph of the article that says many things about the world"
    page = f"""<body><article title="a hidden gem" data-title='the hidden cost of'><h1>Title of it<a aria-hidden="true" href="#t">#</a></h1><p>{prose}. <span style="display:none">x</span></p><p>Not <i class="big hidden">this but</i>here, {prose} <b role="alert">so</b>.</p>
<p>{prose} again <span class="ad">too</span></p><p hidden>{prose} gone.</p><div class="hidden"><p>{prose} gone.</p></div><p class="overflow-hidden" alt=hidden>{prose} last.</p></article><div><span role="dialog">{prose} gone.</span> </div></body>"""
    want = ["Title of it", f"{prose}.", f"Not here, {prose} so.", f"{prose} again too", f"{prose} last."]
    assert html_mincut.main_text(page, html_mincut.trained()).split("\n") == want


PROSE = "A long paragraph of the article that says many things about the world, and then some more."


@pytest.mark.parametrize("name", ["comment-content", "comment-body", "comment-text", "sidebar-content", "footer-text", "cookie-text", "entry comments", "postReplies", ""])
def test_comments_and_notices_go_whatever_their_class(name):
    model = html_mincut.trained()
    two = "".join(f"<div><b>{w}</b> wrote {k + 2} hours ago<p>I think this is a very good text and I want to say so here, {w}.</p></div>" for k, w in enumerate(("Ann", "Bob")))
    plain = f"<div class='{name}'><p>I think this is a very good text and I want to say so.</p><p>No, I do not think so, not at all, my friend.</p></div>"
    for around in ("<article>%s</article>%s", "<article>%s%s</article>", "<div class='post'>%s</div>%s", "<main>%s%s</main>"):
        page = "<body class='has-sidebar'>" + around % (f"<header class='entry-header'><h1>Title of it</h1></header><p>{PROSE}</p><p>{PROSE}</p>", two if not name else plain) + "</body>"
        assert html_mincut.main_text(page, model) == f"Title of it\n{PROSE}\n{PROSE}", around


def test_threads_without_cues_and_dated_articles():
    model = html_mincut.trained()
    flat = "<div>" + "".join(f"<p>{w}, 2021-03-0{k}</p><p>I think this is a very good text and I want to say so here.</p>" for k, w in enumerate(("Ann", "Bob", "Cy"), 1)) + "</div>"
    listed = "<ul>" + "".join(f"<li><span>{w} says:</span><p>I think this is a very good text.</p><p>{PROSE}</p></li>" for w in ("Ann", "Bob", "Cy")) + "</ul>"
    body = f"<h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p>"
    for thread in (flat, listed):
        assert html_mincut.main_text(f"<body><div>{body}</div>{thread}</body>", model) == f"Title of it\n{PROSE}\n{PROSE}"
    dated = f"<body><article><h1>Title of it</h1><p>By Ann, 2021-03-01 10:30</p><p>{PROSE}</p><p>{PROSE}</p></article></body>"
    assert html_mincut.main_text(dated, model) == f"Title of it\nBy Ann, 2021-03-01 10:30\n{PROSE}\n{PROSE}"


def test_forms_go_but_pages_in_a_form_stay():
    model = html_mincut.trained()
    form = "<form><p>Get our letter every week in your mail box.</p><label>Mail</label><input><select><option>a</select><button>Go</button></form>"
    assert html_mincut.main_text(f"<body><form action='x'><input type=hidden><div><h1>Title of it</h1><p>{PROSE}</p><select><option>one</select><p>{PROSE}</p></div><button>Send</button></form></body>", model) == f"Title of it\n{PROSE}\n{PROSE}"
    assert html_mincut.main_text(f"<body><article><h1>Title of it</h1><p>{PROSE}</p>{form}<p>{PROSE}</p></article></body>", model) == f"Title of it\n{PROSE}\n{PROSE}"


def test_empty_tables_long_and_deep_pages_and_clashing_names(spark):
    model = html_mincut.trained()
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    assert html_mincut.main_text(f"<body>{long}</body>", model) == "\n".join([PROSE] * 20_000)
    deep = "<div>" * 20_000 + f"<p>{PROSE}</p>" + "</div>" * 20_000
    assert html_mincut.main_text(f"<body><article>{deep * 3}</article></body>", model) == "\n".join([PROSE] * 3)
    pages = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", "t", 1)], "page_id long, url string, html string, text string, n_chars int").withColumn("key", F.lit(1))
    assert [(r.page_id, r.text) for r in html_mincut.extract(pages).collect()] == [(1, PROSE)]
    assert html_mincut.extract(pages.limit(0)).count() == 0


def test_letters_after_many_signs_count():
    blocks = html_mincut.blocks_of(f"<p>{'1 ' * 150}and prose.</p><p>{'1 ' * 150}</p>")
    assert html_mincut.features(blocks)[:, html_mincut.FEATURES.index("no letters")].tolist() == [0, 1]


# 6 --------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    k = 0
    while k < min(len(a), len(b)) - i and a[-1 - k] == b[-1 - k]:
        k += 1
    return max(len(a), len(b)) - i - k <= 1


def brute_lines(docs):
    lines = sorted(((i is not None, i or 0), n, x.strip(line_dedup.BLANK)) for i, t in docs if t is not None for n, x in enumerate(t.split("\n")))
    lines = [x for x in lines if x[2]]
    first = {}
    for i, n, x in lines:
        first.setdefault(x, (i, n))
    near = {x for x, at in first.items() if any(b < at and within_one(x, y) for y, b in first.items())}
    gone = {(i, n) for i, n, x in lines if (i, n) != first[x] or x in near}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if ((i is not None, i or 0), n) not in gone) for i, t in docs}


def test_lines_equal_brute_force(spark, odd, none):
    r = random.Random(3)

    def edit(x):
        i, k = r.randrange(len(x) + 1), r.randrange(3)
        return x[:i] + r.choice("abé☃ ") + x[i + (k == 0) :] if k < 2 else x[:i] + x[i + 1 :]

    base = ["".join(r.choice("abcé☃ d") for _ in range(r.choice((1, 2, 3, 5, 7, 8, 15, 16, 17, 18, 21, 33, 64, 65, 130, 300)))) for _ in range(40)]
    pool = base + [edit(x) for x in base for _ in range(3)] + [edit(edit(x)) for x in base for _ in range(2)] + ["  ", " x\t", ""]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(90)] + [(None, base[3] + "\n" + base[5]), (500, None), (501, ""), (502, base[8] + "\r\n" + base[8])]
    got = {x.doc_id: x.text for x in line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = brute_lines(docs)
    assert got == want and sum(v is not None and v != dict(docs)[k] for k, v in want.items()) > 20
    kept = line_dedup.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert line_dedup.line_report(none).count() == 0


def test_short_lines_have_the_same_bound(spark):
    docs = [(1, "short line aaaaaaaa"), (2, "short line aaaaaaab\nb"), (3, "ab\nabcd"), (4, "bcd\n\nxyz"), (5, "axyz!\n}")]
    got = {r.doc_id: r.text for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs) and got[2] == "b" and got[4] == "\nxyz"


def test_lines_go_from_their_own_row(spark):
    """Rows without an id or with a common one and different texts."""
    head, near = "a header that all of the documents have", "a long line of which there is a near copy"
    docs = [(None, f"{head}\nown line {k} {'xyz'[k] * 30}\nlast {k * 1111}") for k in range(3)] + [(4, f"{near}\nfour"), (4, f"{near}!\nunique"), (4, f"alone\n{head}"), (None, "twice\n\nthe same"), (None, "twice\n\nthe same"), (None, None), (None, None)]
    got = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(docs)
    kept = [line for r in got if r.text is not None for line in r.text.split("\n")]
    want = {line for _, t in docs if t is not None for line in t.split("\n") if line}
    assert sorted(line for line in kept if line and line[:6] != near[:6]) == sorted(line for line in want if line[:6] != near[:6])
    assert sum(line[:6] == near[:6] for line in kept) == 1 and sum(r.n_dropped for r in got) == 3 - 1 + 1 + 1 + 2


# 7 --------------------------------------------------------------------------


def brute_classes(docs):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        k = min(5, len(w))
        sets.setdefault(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset(), []).append(i)
    keys, up = list(sets), {}
    find = lambda k: k if up.get(k, k) is k else find(up[k])
    links = dict.fromkeys(keys, 0)
    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if x and y and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                links[x] += 1
                links[y] += 1
                if find(x) is not find(y):
                    up[find(x)] = find(y)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(i for i in sets[k] if i is not None)
    return sorted(((str(i), str(min(groups[find(k)], default=None)), links[k]) for k in keys for i in sets[k]))


@pytest.mark.parametrize("bucket", [16, 1024])
def test_join_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    monkeypatch.setattr(chosen_path, "TILE_SETS", bucket)
    r, docs = random.Random(2), []
    for _ in range(20):
        base = [f"w{r.randrange(900)}" for _ in range(r.choice((1, 3, 4, 5, 6, 30, 60, 120)))]
        for _ in range(r.randrange(1, 7)):
            x = list(base)
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = f"v{r.randrange(50)}"
            docs.append((len(docs), " ".join(x)))
    for c in range(60):
        docs.append((len(docs), "  ".join(f"z{c}" if k == c else f"h{k}" for k in range(80))))
    docs += [(9000, None), (9001, ""), (9002, " \n"), (None, docs[3][1]), (None, "solo null"), (4, docs[9][1])]
    got = chosen_path.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in got) == brute_classes(docs)


def test_contained_pairs_meet_below_nodes_of_any_depth():
    """Of sets at Jaccard 0.8, one inside the other, enough share a node seven levels down in some run."""
    r, met = np.random.default_rng(6), 0

    def reached(s, depth):
        slots, tokens = chosen_path.sampled(s)
        keys, paths = chosen_path.mix(tokens.view(np.uint64) ^ chosen_path.mix(slots.astype(np.uint64) + np.uint64(1))), [[t] for t in tokens.tolist()]
        for _ in range(depth):
            i, token, keys = chosen_path.descents(s, keys, paths)
            paths = [[*paths[k], t] for k, t in zip(i.tolist(), token.view(np.int64).tolist(), strict=True)]
        return set(keys.tolist())

    for _ in range(60):
        s = np.sort(r.integers(0, 1 << 63, 100, dtype=np.uint64))
        met += bool(reached(s, 6) & reached(s[np.sort(r.permutation(100)[:80])], 6))
    assert met >= 56


def test_large_groups_of_copies_go_by_pivots_and_cores(spark, monkeypatch):
    """A group far above a bucket and a tile, some members only near others: equal to brute force, edges in proportion."""
    monkeypatch.setattr(chosen_path, "BUCKET", 16)
    monkeypatch.setattr(chosen_path, "TILE_SETS", 32)
    r, docs = random.Random(9), []
    base = [f"w{k}" for k in range(120)]
    for _ in range(220):
        x = list(base)
        for _ in range(r.choice((0, 1, 1, 1, 2, 3, 4))):
            x[r.randrange(len(x))] = f"v{r.randrange(3000)}"
        docs.append((len(docs), " ".join(x)))
    line = " ".join(f"common{k}" for k in range(12))
    docs += [(1000 + k, line + " " + " ".join(f"o{k}x{j}" for j in range(60))) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = chosen_path.classes(df).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in got) == brute_classes(docs)
    edges, _ = chosen_path.candidate_edges(df, chosen_path.features(df))
    assert edges.count() < 40 * chosen_path.RUNS * len(docs) / 10


def test_pairs_are_counted_in_one_tile(spark, monkeypatch):
    """Two near copies of many tokens are dealt to several tiles, most of which hold one chunk or none."""
    monkeypatch.setattr(chosen_path, "TILE_TOKENS", 100)
    docs = [(2 * c + k, " ".join(f"c{c}w{j}" for j in range(60 + k))) for c in range(40) for k in range(2)]
    got = chosen_path.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 80 and {(r.n_links, r.class_id == r.doc_id - r.doc_id % 2) for r in got} == {(1, True)}


def test_filtered_rows_hold_all_keys_and_few_others(spark, tmp_path):
    rows = spark.range(20000).selectExpr("id", "xxhash64(id) as h")
    rows.where("id % 20 = 0").select("h").write.parquet(str(tmp_path / "keys"))
    got = {r.id for r in common.perhaps_in(rows, spark.read.parquet(str(tmp_path / "keys"))).collect()}
    assert got >= set(range(0, 20000, 20)) and len(got) < 1500


def test_sets_are_made_without_a_shuffle_of_texts(spark):
    docs = spark.createDataFrame([(k, f"some words of text number {k} and more") for k in range(50)], "doc_id long, text string")
    feats = common.written(chosen_path.features(docs), "test-features")
    one = common.written(feats.where("doc_id % 7 = 0").selectExpr("sid", "struct(doc_id, text_hash) as _rep"), "test-sets")
    got = chosen_path.whole_sets(docs, one)
    assert {bytes(r.sid) for r in got.collect()} == {bytes(r.sid) for r in one.collect()}
    shuffled = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x or "Aggregate" in x]
    assert shuffled and not any("text#" in x for x in shuffled if "_word" not in x)


def test_copies_are_in_nodes_once(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(40))) for k in range(300)], "doc_id long, text string").coalesce(1)
    got = chosen_path.features(docs).selectExpr("sid", "sketch", "size(tokens) as n").collect()
    assert len(got) == 300 and sum(r.n > 0 for r in got) == 1 and len({(bytes(r.sid), bytes(r.sketch)) for r in got}) == 1


@pytest.mark.parametrize("at_once", [1 << 18, 40])
def test_components_of_few_and_of_many_edges(spark, monkeypatch, at_once):
    """Few edges take two written tables, without a join; more end in rounds of joins; both equal a plain union."""
    monkeypatch.setattr(common, "EDGES", at_once)
    r, up, made = random.Random(3), list(range(200)), []
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    for a, b in edges:
        up = [up[min(a, b)] if x == up[max(a, b)] else x for x in up]
    least = {x: min(k for k in range(200) if up[k] == x) for x in up}
    plain = common.written
    monkeypatch.setattr(common, "written", lambda df, label: made.append(label) or plain(df, label))
    got = {x.id: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {k: least[up[k]] for a, b in edges if a != b for k in (a, b)} and (len(made) == 2) == (at_once > 150)


def test_one_of_each_keeps_columns(odd, none):
    got = chosen_path.one_of_each(odd)
    assert got.columns == odd.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "7", "8", "None"]
    assert chosen_path.classes(none).count() == 0 and chosen_path.one_of_each(none).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Rows without an id or with a common one have different texts; each class keeps exactly one row."""
    texts = [" ".join(f"t{c}w{k}" for k in range(40)) for c in range(6)]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (3, texts[5]), (5, texts[5]), (None, texts[5] + " end")]
    got = chosen_path.one_of_each(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], DOC).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("5", texts[3]), ("5", texts[4]), ("3", texts[5])])


# 8 --------------------------------------------------------------------------


def made_texts(r, n, toxic):
    word = lambda: "".join(r.choice(("lo", "ra", "tem", "is", "un", "der", "qua", "en")) for _ in range(r.randrange(1, 5)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.randrange(10, 120))]
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[r.randrange(len(w))] = r.choice(("grumpfel", "snarkzig", "blorptok"))
        out.append(" ".join(w))
    return out


def test_toxic_words_and_their_misspellings(spark, odd, none):
    r = random.Random(1)
    texts, labels = made_texts(r, 300, False) + made_texts(r, 120, True), [0] * 300 + [1] * 120
    model = toxicity.train(texts, labels)
    clean, bad = model.scores(made_texts(r, 200, False)), model.scores(made_texts(r, 80, True))
    assert (clean < 0.5).mean() > 0.95 and (bad >= 0.5).mean() > 0.95
    assert model.scores(["tem is der grumpffel un qua"])[0] > 0.5 > model.scores([""])[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(0, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, marks).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out]
    assert (held.predicted.to_numpy() == np.array(labels)[held.doc_id]).mean() > 0.95
    assert toxicity.keep_clean(odd, marks).columns == odd.columns
    assert toxicity.toxicity_report(odd, marks.limit(0)).count() == len(ODD) and toxicity.toxicity_report(none, marks).count() == 0


def test_passages_and_words_agree_with_a_plain_model():
    data = "Añ-b cdé  x1".lower().encode()
    begin, words, grams = toxicity.words_and_grams(data)
    assert len(begin) == 4 and set(words.tolist()) == {0, 1, 2, 3}
    single = [toxicity.words_and_grams(w.encode())[2] for w in ("añ", "b", "cdé", "x1")]
    for k, g in enumerate(single):
        assert sorted(grams[words == k].tolist()) == sorted(g.tolist())


def plain_logit(text, model):
    """Word by word and n-gram by n-gram, as the module's docstring says it."""
    words, run = [], b""
    for c in text.lower().encode("utf-8", "replace") + b" ":
        if c >= 128 or chr(c).isalnum():
            run += bytes([c])
        elif run:
            words.append(run)
            run = b""
    scores = []
    for w in words:
        w, found = b" " + w + b" ", []
        for n in (3, 4, 5, 6):
            for i in range(len(w) - n + 1):
                h = 0
                for c in w[i : i + n]:
                    h = (h * 16777619 + c) % 2**32
                h = (h * 2654435761 + n * 40503) % 2**32
                found.append(float(model.table[(h ^ h >> 15) % toxicity.BUCKETS]))
        scores.append(sum(found) / len(found))
    k = max(1, round(len(scores) / toxicity.PASSAGE))
    cut = [i * len(scores) // k for i in range(k + 1)]
    return model.bias + max(sum(scores[a:b]) / (b - a) for a, b in zip(cut, cut[1:], strict=False)) if scores else float("-inf")


def test_scores_equal_a_plain_model():
    r = random.Random(5)
    model = toxicity.train(made_texts(r, 80, False) + made_texts(r, 40, True), [0] * 80 + [1] * 40)
    texts = [*made_texts(r, 20, False), *made_texts(r, 20, True), "", " .,;\n", "a", "Ünïcödé GRUMPFEL, tem!", "\u4e2d\u6587 \U0001f600", "word " * 5_000 + "snarkzig"]
    want = [plain_logit(t, model) for t in texts]
    assert np.allclose(model.logits(texts), want, rtol=1e-5, atol=1e-5)
    for k, t in enumerate(texts):  # alone as in a batch
        assert np.allclose(model.logits([t]), want[k : k + 1], rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("seed", [1, 2])
def test_training_learns_from_a_random_start(seed):
    """Toxic words are about one in thirty and the start knows nothing of them: what tells the classes apart comes from the gradients."""
    r = random.Random(20 + seed)
    model = toxicity.train(made_texts(r, 400, False) + made_texts(r, 160, True), [0] * 400 + [1] * 160, seed)
    clean, bad = model.logits(made_texts(r, 300, False)), model.logits(made_texts(r, 120, True))
    assert (bad[:, None] > clean[None, :]).mean() > 0.99


def test_joint_training_adds_to_its_start(monkeypatch):
    r = random.Random(8)
    texts, labels = made_texts(r, 300, False) + made_texts(r, 120, True), [0] * 300 + [1] * 120
    clean, bad = made_texts(r, 300, False), made_texts(r, 120, True)

    def right():
        model = toxicity.train(texts, labels)
        return ((model.scores(clean) < 0.5).mean() + (model.scores(bad) >= 0.5).mean()) / 2

    joint = right()
    monkeypatch.setattr(toxicity, "_fit", lambda *a: None)
    assert joint >= right() and joint > 0.95


def test_equal_labelled_ids_and_very_long_texts(spark):
    r = random.Random(3)
    texts = made_texts(r, 150, False) + made_texts(r, 60, True)
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (1, texts[1]), (900, "tem un der " * 40_000 + "grumpfel snarkzig blorptok grumpfel")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 150)) for i in range(210)] + [(1, 0), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, marks).toPandas()
    assert len(got) == 213 and (got[got.doc_id == 1].score.nunique(), len(got[got.doc_id == 1])) == (1, 3)
    assert got[got.doc_id == 900].score.iloc[0] > 0.5 > got[got.doc_id == 1].score.iloc[0]


# 9 --------------------------------------------------------------------------

EMAIL, IP, CARD, PHONE = map(re.compile, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    for letters in ("ab@.-1 ", "0123456789. -", "+1234 ().-5", "a@b.c-é1٣+%_"):
        for _ in range(6000):
            t = "".join(r.choice(letters) for _ in range(r.randrange(45)))
            assert pii.base_spans(t) == brute_spans(t), t


def test_model_adds_forms_and_leaves_prose_alone(odd, none):
    model = pii.trained()
    t = "Write to bob at example dot com or call 555-123-4567, version 1.2.3 of 2026-01-02, look at the dot of order 12345678."
    added = [(t[b:e], pii.KINDS[k]) for b, e, k in pii.all_spans(t, pii.base_spans(t), model)]
    assert added == [("bob at example dot com", "email"), ("555-123-4567", "phone")]
    right = total = 0
    for text, spans in pii.generated_sentences(100, seed=99):
        right += len(set(model.best(pii.Stretch(text))) & spans)
        total += len(spans)
    assert right / total > 0.97
    got = pii.find_spans(odd).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_spans(none).count() == 0


def test_addresses_of_any_length_and_many_parts():
    model, long = pii.trained(), "lin" * 40
    for address in (f"bob at {long} dot com", f"bob at{' ' * 90}example dot com", "bob (at) mail (dot) example (dot) com", f"{'b' * 30} at {'c' * 70} dot com", "ann.lee_07 [at] a [dot] b [dot] c [dot] d [dot] org", "ann(at)mail(dot)com"):
        t = f"Please write to {address} now."
        assert [(t[b:e], k) for b, e, k in pii.all_spans(t, [], model)] == [(address, 0)], address
    t = f"call {long} {long} 555-123-4567 now"
    assert pii.all_spans(t, [], model) == [(t.index("555"), t.index("555") + 12, 3)]


def test_long_texts_take_linear_time():
    import time

    model = pii.trained()
    def seconds(text):
        begun = time.process_time()
        pii.all_spans(text, pii.base_spans(text), model)
        return time.process_time() - begun

    for unit in ("555-123-4567x", "1.1.", "7", "a at b dot ", "abc", "(555)", "12 ", "bob@"):
        # four times the text takes about four times as long; sixteen times would be quadratic
        assert seconds(unit * (240_000 // len(unit))) < 9 * max(0.3, seconds(unit * (60_000 // len(unit)))), unit


def test_decoder_equals_enumerated_segmentations():
    model, r = pii.trained(), random.Random(8)
    pieces = ("555", "123", "4567", "(", ")", "-", ".", " ", " ", "call", "bob", "at", "dot", "com", "+1", "4111 1111 1111 1111", "10 . 2 . 3 . 4", "/")
    seen = 0
    for _ in range(400):
        s = pii.Stretch(" ".join(r.choice(pieces) for _ in range(r.randrange(3, 12))))
        arcs = [(i, j, float(model.weights[k] @ x)) for i, j, k, x in s.arcs]
        if len(arcs) > 12:
            continue
        best = 0.0
        for m in range(1 << len(arcs)):
            chosen = sorted(a for k, a in enumerate(arcs) if m >> k & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                best = max(best, sum(a[2] for a in chosen))
        of = {(s.tokens[i][0], s.tokens[j - 1][1], k): float(model.weights[k] @ x) for i, j, k, x in s.arcs}
        assert abs(sum(of[x] for x in model.best(s)) - best) < 1e-9
        seen += best > 0
    assert seen > 40


def test_gradient_equals_differences():
    model = pii.SemiMarkov({k: np.zeros(len(pii.FEATURES)) for k in pii.KINDS})
    text, spans = next((t, s) for t, s in pii.generated_sentences(30, seed=3) if s)
    s = pii.Stretch(text)
    _, g = model.gradient(s, spans)
    for kind in pii.KINDS:
        for i in (0, 1, 8):
            model.weights[kind][i] = 1e-5
            up = model.gradient(s, spans)[0]
            model.weights[kind][i] = -1e-5
            down = model.gradient(s, spans)[0]
            model.weights[kind][i] = 0
            assert abs((up - down) / 2e-5 - g[kind][i]) < 1e-3


# 10 -------------------------------------------------------------------------


def test_archives_are_deterministic_and_revisit_copies(spark, tmp_path):
    h = "x" * 1500
    data = [(1, "u a", h, 9), (5, "v", h, 9), (5, "w", h, 9), (None, "n", h, 9), (7, None, None, 9), (8, "q", "é" * 400, 9), (9, "q", "é" * 400, 9), (9, "q", "é" * 600, 9), (12, "q", "é" * 600, 9), (-4, "neg", "y" * 999, 9)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, shard int")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_report(pages).collect())
    assert got == sorted([("1", 1500, "revisit", 5), ("5", 1500, "response", None), ("5", 1500, "response", None), ("None", 1500, "revisit", 5), ("7", 0, "response", None), ("8", 800, "response", None), ("9", 800, "response", None), ("9", 1200, "revisit", 12), ("12", 1200, "response", None), ("-4", 999, "response", None)])
    real = spark.read.parquet(f"{SF}/pages.parquet")
    a = warc.write_archives(real, f"{tmp_path}/a", 60_000, 20_000).orderBy("name").toPandas()
    b = warc.write_archives(real.repartition(7), f"{tmp_path}/b", 60_000, 20_000).orderBy("name").toPandas()
    assert len(a) > 3 and a.sha256.tolist() == b.sha256.tolist() and a.records.sum() == real.count()
    assert not list((tmp_path / "a").glob("_temporary*"))
    (tmp_path / "a" / "part-999999-0000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_archives(spark, f"{tmp_path}/a").count() == real.count()
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_shards_weigh_empty_pages_and_part_equal_payloads_by_url(spark, tmp_path):
    empty = spark.range(3000).selectExpr("id as page_id", "concat('u', id) as url", "cast(null as string) as html")
    made = warc.write_archives(empty, str(tmp_path / "a"), shard_bytes=100_000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert sum(r.n for r in made) == 3000 and len(made) > 15 and max(r.n for r in made) < 300
    same = spark.range(2000).select(F.lit(7).cast("long").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("p" * 1200).alias("html")).unionByName(spark.createDataFrame([(9, "v", "p" * 1200)], "page_id long, url string, html string"))
    root = str(tmp_path / "b")
    made = warc.write_archives(same, root, shard_bytes=200_000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert len(made) > 15 and max(r.n for r in made) < 250
    got = warc.read_archives(spark, root)
    assert got.where("record_type = 'revisit' and refers_to = 9 and page_id = 7").select("url").distinct().count() == 2000 and got.count() == 2001
    again = str(tmp_path / "c")
    warc.write_archives(same.repartition(7, "url"), again, shard_bytes=200_000)
    names = [{(r.name, r.sha256) for r in spark.read.parquet(f"{x}/_manifest").collect()} for x in (root, again)]
    assert names[0] == names[1]


def test_shards_are_even_for_clustered_ids_and_outliers(spark, tmp_path):
    """Ids in a cluster with outliers far away, one id with a third of all rows, one long record."""
    ids = [*range(400), 2**62, -(2**62), *[77] * 200, None]
    data = [(i, "u", f"{k} " + "t" * 1000) for k, i in enumerate(ids)] + [(500, "u", "long " * 40_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    a = warc.write_archives(pages, f"{tmp_path}/a", 20_000, 1 << 30).orderBy("name").toPandas()
    b = warc.write_archives(pages.repartition(9), f"{tmp_path}/b", 20_000, 1 << 30).orderBy("name").toPandas()
    assert a.sha256.tolist() == b.sha256.tolist() and a.records.sum() == len(data)
    # a record weighs its payload, its url and 700 bytes of headers
    assert 50 <= len(a) <= 58 and sorted(a.records)[-1] <= 13
    got = warc.read_archives(spark, f"{tmp_path}/a").toPandas()
    assert sorted(got.page_id.fillna(-1)) == sorted(-1 if i is None else i for i, *_ in data) and got.payload_bytes.max() == 200_000


def test_damaged_archives_are_noticed():
    record = warc.build_record(1, "http://a", b"payload", None)
    assert [b for _, b in warc.parse_records(warc.gzip_member(record))][0].endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.gzip_member(record.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))))


WRAPPERS = ["<div>", '<div class="post">', '<div class="content-with-sidebar">', '<div class="main sidebar-right">', '<article class="post comments-open">', '<div class="social-science">', '<div class="search-page"><article>', '<article id="more-than-words">', '<div class="discussion-paper">', '<section class="copyright-law">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_class_words_of_the_page_keep_its_article(wrapper):
    model, long = html_mincut.trained(), f"{PROSE} " * 3
    article = f"{wrapper}<h1>Title of it</h1>{f'<p>{long}</p>' * 4}{''.join(f'</{t}>' for t in re.findall('<([a-z]+)', wrapper)[::-1])}"
    want = "\n".join(["Title of it", *[long.strip()] * 4])
    assert html_mincut.main_text(f"<body>{article}</body>", model) == want
    for furniture in ("comments", "comment-list", "disqus", "responses replies", "respond", "discussion", "sidebar", "footer"):
        assert html_mincut.main_text(f"<body>{article}<div class='{furniture}'><p>{long}</p><p>{long}</p></div></body>", model) == want, furniture


def test_costs_hold_for_class_words_not_trained_on():
    names = sorted(html_mincut.BAD)
    for seen, unseen in ((names[::2], names[1::2]), (names[1::2], names[::2])):
        weights, right, n = html_mincut.trained(named=tuple(seen)), 0, 0
        for page in html_mincut.generated_pages(60, 77, tuple(unseen)):
            blocks = html_mincut.blocks_of(page)
            kept = {id(b) for b in html_mincut.content_blocks(blocks, weights)}
            right, n = right + sum((id(b) in kept) == (b.text[0] == "Q") for b in blocks), n + len(blocks)
        assert right / n > 0.98


def test_a_form_that_holds_the_prose_is_kept():
    model = html_mincut.trained()
    assert html_mincut.main_text(f"<body><form><p>{PROSE}</p></form></body>", model) == PROSE
    assert html_mincut.main_text(f"<body><p>{PROSE}</p><form><p>{PROSE}</p></form></body>", model) == PROSE


@pytest.mark.parametrize("unit", ["at.", "at-", "at dot ", "a at b ", "(at) ", "at_", "x at y dot "])
def test_chains_of_at_and_dot_take_linear_time(unit):
    import time

    def took(n):
        text, began = unit * n + " dot", time.perf_counter()
        pii.all_spans(text, pii.base_spans(text), model)
        return time.perf_counter() - began

    model = pii.trained()
    took(500)
    assert took(24_000) < 12 * max(0.05, took(6_000))


def test_types_follow_the_form():
    model = pii.trained()
    kinds = lambda t: pii.joined(pii.all_spans(t, pii.base_spans(t), model))
    assert kinds("tel. 0171 / 23 45 678 00") == "phone:5:24"
    assert kinds("call 06 12 34 56 78 today") == "phone:5:19"
    assert kinds("form 123-45-6789 of it") == ""
    assert kinds("host 192 . 168 . 0 . 1") == "ip:5:22"
    assert kinds("bob at mail dot example dot com") == "email:0:31"


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    from tidewatch.llm.common import slices

    b = pa.RecordBatch.from_pydict({"text": ["x" * 50, None, "", "ab", "c" * 9, "d" * 5, "e"], "k": list(range(7))})
    got = [p.column("k").to_pylist() for p in slices(b, "text", most=3, size=10)]
    assert got == [[0], [1, 2, 3], [4], [5, 6]]
