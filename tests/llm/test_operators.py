"""Each operator against a brute-force version, and over nulls, empties, ties, repeats and clashing columns."""

import binascii
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from noteloom.llm import bagminhash, bpe, brown_lm, common, embed_dedup, graph, gru_lid, html_extract, license_scan, media_cdc, mixing, queries, url_filter
from noteloom.llm.common import join_one, stash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, u long, v long, same string, n long, size long, key string, score double, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, 1, 2, 3, "x", 4, 5, "k", 0.5, "w") for i, t, l, s in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "a"), (4, "hello world", "en", "b"), (4, "hello world", "en", "b"), (5, LONG, "fr", "b"), (6, LONG, "fr", None), (None, "no id here at all", "en", "c"), (7, "éà ñ 12 %%% \u00a0\u2003 x\x1cy", "fr", "c"), (8, "12345 !!!", None, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).limit(0)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_hot_keys_meet_their_row_once(spark, monkeypatch):
    """join_one against a plain join, with hot keys broadcast, too many of them, and none; null keys meet nothing."""
    many = spark.createDataFrame([(k, i) for i in range(40) for k in ("hot", f"k{i % 7}", None)], "k string, i long")
    one = many.groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", F.length("k").cast("long"))
    one = stash(one.unionByName(spark.createDataFrame([("alone", 0, 5)], "k string, n long, x long")), "test")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one.drop("n"), "k", how).collect()))
        for hot, keys in ((1000, 10), (5, 10), (5, 1), (0, 100), (0, 3)):
            got = join_one(many, one, "k", "n", keys=keys, hot=hot, how=how)
            assert got.columns == ["k", "i", "x"] and sorted(map(str, got.collect())) == want


def test_operators_on_hot_keys(spark, monkeypatch):
    """A third of all rows in one group of copies, one bucket, one hub, one vector, one source and id: the same results."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(bagminhash, "CHUNK", 4)
    monkeypatch.setattr(bagminhash, "TILE", 4)
    monkeypatch.setattr(common.join_one, "__defaults__", (common.HOT_KEYS, 3, "inner"))
    base = " ".join(f"word{i}" for i in range(60))
    near = [base + f" end{i}" for i in range(30)]
    rows = [(i, base, "en", "a") for i in range(30)] + [(100 + i, t, "en", "a") for i, t in enumerate(near)] + [(200 + i, f"text {i} " + " ".join(f"v{i}x{j}" for j in range(20)), "en", "b") for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in bagminhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 0 if i < 200 else i for i, *_ in rows}
    star = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(60, 61), (61, 62)], "u long, v long")
    assert {r["node"]: r["component"] for r in graph.components(star).collect()} == {**dict.fromkeys(range(50), 0), 60: 60, 61: 60, 62: 60}
    vec = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(20)] + [(20, [0.0, 1.0, 0.0]), (21, None), (22, [1.0, 0.1, 0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_links(vec, "vec_id", "embedding", 0.95).collect()}
    assert got == {**{i: (20, 0) for i in range(20)}, 20: (0, 20), 21: (0, 21), 22: (20, 0)}


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(e, "u long, v long")).collect()}
    e = [(a, b) for a, b in e if a is not None and a != b]
    assert got == roots({x for p in e for x in p}, e)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1


def brute_links(rows, t=0.95):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, links = collections.Counter(), []
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / (np.linalg.norm(ok[a][1]) * np.linalg.norm(ok[b][1])) >= t:
                n[ok[a][0]] += 1
                links.append((ok[a][0], ok[b][0]))
    return n, roots({i for i, _ in rows if i is not None}, links)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 30] + rng.normal(0, 0.02 * (1 + i % 13), 16)]) for i in range(240)]
    rows += [(900 + i, rows[0][1]) for i in range(5)] + [(910, None), (911, []), (912, [0.0] * 16), (913, [float("nan")] * 16), (914, [None] * 16), (915, [1.0, 0.0]), (916, [0.999, 0.001]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node long, links long")
    for size in (40, 4096):
        got = embed_dedup.near_links(df, "vec_id", "embedding", block_rows=size).collect()
        assert len(got) == len(rows)
        n, comp = brute_links(rows)
        for r in got:
            if r["vec_id"] is not None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], comp[r["vec_id"]], comp[r["vec_id"]] == r["vec_id"]), r
    assert embed_dedup.near_links(df.limit(0), "vec_id", "embedding").count() == 0


def test_quantisation_bound():
    x = np.random.default_rng(2).normal(size=(200, 64))
    q, s, e = embed_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(u @ u.T - approx) <= e[:, None] * (1 + e) + e + 1e-9).all()
    i, j = map(np.concatenate, zip(*embed_dedup.tile_links(x, x, 0.2, True)))
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.2)) if a != b}


# 2


def test_urls(spark):
    urls = ["http://a.net/x", "https://WWW.Example.NET/en/1?q=1", "http://example.com/de/", "http://x.org/fr/1#a", "http://x.org/en", "no scheme", None, "", "http://net", "http://example.net.evil.com/en/", "http://a.net/x", "ftp://b.net?x://c/", "http://notexample.com/de/x"]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=lambda r: len(r[0]), default=(None, None))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0]), u
        assert r["verdict"] == rule[1] if rule[0] else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    plain = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(plain).select("verdict", "score").collect()] == [("allow", 0.5)]


def test_trees_learn(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, len(url_filter.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    bias, trees = url_filter.fit_trees(x[:2000], y[:2000])
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x[2000:], y[2000:])], ", ".join(f"{f} double" for f in url_filter.FEATURES) + ", y double")
    from pyspark.sql import functions as F

    margin = F.lit(bias)
    for t in trees:
        margin = margin + url_filter.tree_column(t)
    assert df.select(F.avg(((margin > 0) == (F.col("y") > 0.5)).cast("double"))).first()[0] > 0.93


# 3


def test_pages(spark):
    page = "<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><header>Site</header><nav><ul><li><a href=/>menu</a></ul></nav><div class='cookie-notice'>We use cookies</div><div class='wrap-{n}'><div class='post'><h1>Head &amp; more</h1><p>First <b>bold</b>ly\n  done.<p>Second &eacute;&#33; line<br>here, long enough to count.</p><form>Name <input></form><div class='ad'>Buy</div></div><div class='sidebar'><p>Other things to read</p></div><section id='comments'><p>A comment by a reader that is very long, far longer than all of the article above, to draw votes.</p></section></div><footer>&copy; x</footer></body></html>"
    want = "Head & more First boldly done. Second é! line here, long enough to count."
    rows = [(i, f"http://h.com/{i}", page.replace("{n}", str(i))) for i in range(5)] + [(6, "http://h.com/x", None), (7, None, "<p>alone &lt;x"), (8, "http://h.com/y", ""), (9, "http://h.com/z", page[:420]), (10, "http://o.com", "just text"), (10, "http://o.com", "just text"), (11, "http://o.com", "<div>" * 300 + "deep"), (None, "http://q.com", "<article>a<br>b</article>")]
    df = spark.createDataFrame([(*r, "t", 3, "h") for r in rows], "page_id long, url string, html string, text string, n_chars long, host string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == want for i in range(5))
    assert (by[6], by[7], by[8], by[10], by[11], by[None]) == ("", "alone <x", "", "just text", "deep", "a b")
    assert by[9].startswith("Head & more")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_pages_keep_all_of_the_article():
    long = "Words of the article, a sentence that is long enough. " * 8
    body = f"<p>{long}</p>"
    cases = [
        (f"<article><h1>Title</h1><div class='body'>{body}</div></article>", f"Title {long}"),
        (f"<main><h1>Title</h1><section class='a'>{body * 3}</section><section class='b'><p>Second part.</p></section></main>", f"Title {long * 3} Second part."),
        (f"<article><p>Before the list.</p><ul><li>{long}</li><li>{long}</li></ul><p>After it.</p></article>", f"Before the list. {long * 2} After it."),
        (f"<div class='post'><h1>Title</h1><div class='body'>{body}</div></div><div class='links'><a href=/a>Another page</a> <a href=/b>And one more</a></div>", f"Title {long}"),
    ]
    for source, want in cases:
        page = html_extract.Page(f"<html><body><nav>Menu</nav>{source}<footer>End</footer></body></html>")
        assert page.text(page.best()).split() == want.split(), source


def test_pages_keep_articles_that_only_look_like_boilerplate():
    text = "Words of the article, a sentence that is long enough."
    for attrs in ("style='overflow:hidden'", "aria-hidden=false", "data-id='nav'", "data-role=search", "class='content has-sidebar'", "class='entry no-comments'", "class='page-with-sidebar'", "class='nav'", "hidden"):
        page = html_extract.Page(f"<body><nav>Menu</nav><div {attrs}><p>{text}</p></div><footer>End</footer></body>")
        assert page.text(page.best()) == text, attrs
    for attrs in ("hidden", "class='main-nav'", "ID = nav", "role=search", "style='x' hidden=hidden class='a'"):
        page = html_extract.Page(f"<body><div {attrs}><p>Not of it, but quite as long as the article is itself.</p></div><p>{text}</p></body>")
        assert page.text(page.best()) == text, attrs
    for attrs in ("style='overflow:hidden'", "data-id='nav'", "data-role=search", "class='content has-sidebar'"):
        page = html_extract.Page(f"<body><div {attrs}><p>{text}</p></div><div><p>Short.</p></div></body>")
        assert text in page.text(page.best()), attrs


def test_pages_of_the_table(spark, sf):
    import html

    for r in html_extract.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r["html"].split("<article>", 1)[1].split("</article>")[0]
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>|<[^>]*\Z", "", article))).split())


# 4


def bag(text):
    w = WORDS.findall(lower(text))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def similar(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute_classes(rows, t=0.8):
    bags = [(i, bag(x)) for i, x in rows if i is not None]
    bags = [(i, b) for i, b in bags if b]
    links = [(a, b) for k, (a, x) in enumerate(bags) for b, y in bags[:k] if similar(x, y) >= t]
    return roots({i for i, _ in rows if i is not None}, links)


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.integers(0, 60)}" for _ in range(int(rng.integers(6, 300)))]
        for _ in range(9):
            w = list(words)
            for _ in range(int(rng.integers(0, 1 + len(w) // 40))):
                w[rng.integers(0, len(w))] = f"new{rng.integers(0, 10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(2000, "a b c d"), (2001, "A  b c D"), (2002, "loop " * 400), (2003, "loop " * 420), (2004, "loop " * 900)]
    got = bagminhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    want = brute_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    got = bagminhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), None: (None, True), 7: (7, True), 8: (8, True)}
    assert bagminhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_the_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in bagminhash.near_duplicates(d).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in d.collect()])


def test_bounds_hold(spark):
    rng = np.random.default_rng(15)
    bags = []
    for k in range(40):
        keys = rng.choice(4000, int(rng.integers(5, 900)), replace=False) if k % 2 or not bags else np.array([*list(bags[-1])[int(rng.integers(0, 40)) :], *rng.choice(4000, 9)])
        bags.append({int(x): int(rng.integers(1, 4)) if k % 2 else bags[-1].get(int(x), 1) if bags else 1 for x in keys})
    h = lambda ks: bagminhash.mix64(np.array(ks, np.uint64))
    bits = np.concatenate([bagminhash.bit_sets(np.zeros(len(b), np.int64), h(list(b)), 1) for b in bags]).tolist()
    rows = [(i, sum(b.values()), x) for i, (b, x) in enumerate(zip(bags, bits))]
    side = lambda x: spark.createDataFrame(rows, f"{x} long, n{x} long, b{x} array<long>")
    got = {(r["u"], r["v"]) for r in side("u").crossJoin(side("v")).where(bagminhash.may_reach("u", "v")).collect()}
    true = {(i, j) for i, a in enumerate(bags) for j, b in enumerate(bags) if similar(collections.Counter(a), collections.Counter(b)) >= 0.8}
    assert true <= got and len(got) < 40 * 40 / 2


def test_signatures_are_unbiased():
    rng = np.random.default_rng(6)
    for _ in range(4):
        a = {int(k): int(rng.integers(1, 40)) for k in range(60)}
        b = {k: max(1, w + int(rng.integers(-9, 9))) for k, w in a.items() if k > 8}
        h = lambda k: bagminhash.mix64(np.array([k + 12345], np.uint64))[0]
        items = sorted((d, h(k), w) for d, x in enumerate((a, b)) for k, w in x.items())
        s = bagminhash.bag_signatures(*(np.array(c, t) for c, t in zip(zip(*items), (np.int64, np.uint64, np.int64))), 2, 6000)
        true = sum(min(a[k], b.get(k, 0)) for k in a) / sum(max(a[k], b.get(k, 0)) for k in a)
        assert abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 6000) + 1e-3


# 5


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.TextCodec(bpe.PrefixEncoder(ranks), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, none, sf, codec):
    own, theirs = codec
    for df, n in ((odd, len(ODD)), (spark.read.parquet(f"{sf}/documents.parquet"), None)):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        got = bpe.encode_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
        assert n is None or len(got) == n
        for r in got:
            ids = theirs.encode_ordinary(texts[r["doc_id"]])
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_documents(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_of_odd_strings(codec):
    own, theirs = codec
    rng = np.random.default_rng(7)
    alphabet = list("aAbe '\n\t\r\x0b\x1c\x1d\x85\u00a0\u2003\u3000!?.19é日本ß🙂\u0301’") + ["'s", "'ll", "  ", "the ", "ing"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet, int(rng.integers(0, 40))))
        assert own.encode(t) == " ".join(map(str, theirs.encode_ordinary(t))), repr(t)
        assert own.decode(own.encode(t)) == t.encode()
    for t in ("a" * 3000, "ab" * 2000, " " * 700 + "x", "é" * 500, "日" * 400):
        assert own.encode(t) == " ".join(map(str, theirs.encode_ordinary(t)))


def test_bpe_appends_and_edits(codec):
    e = codec[0].encoder
    rng = np.random.default_rng(8)
    pool = b"therinanesoft  eionha.,12"
    make = lambda n: bytes(rng.choice(list(pool), n).tolist())
    for _ in range(40):
        p = bpe.Piece(e, make(int(rng.integers(0, 400))))
        p.append(make(int(rng.integers(0, 60))))
        assert p.ids() == e.read(e.extend([-1], p.data), len(p.data))
        a = int(rng.integers(0, len(p.data) + 1))
        b = min(len(p.data), a + int(rng.integers(0, 9)))
        want = p.data[:a] + (new := make(int(rng.integers(0, 7)))) + p.data[b:]
        p.edit(a, b, new)
        assert p.data == want and p.ids() == e.read(e.extend([-1], want), len(want))
    p = bpe.Piece(e, make(20_000))
    assert p.edit(100, 101, b"x") < 5_000
    assert p.ids() == e.read(e.extend([-1], p.data), len(p.data))


# 6


def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), at


def test_licenses(spark, odd, none, sf):
    cases = [(20, "MIT License mit license, Apache License; the GNU GENERAL PUBLIC LICENSE é1"), (21, "x " * 30 + license_scan.TEMPLATES[0][1] + " y" * 20), (22, "Released under the MIT License."), (23, license_scan.TEMPLATES[2][1].replace("obtain", "get")), (24, "mit\x00license public license general public general public license"), (25, "free of charge to any person")]
    for df in (odd, docs(spark, [(i, t, "en", "s") for i, t in cases]), spark.read.parquet(f"{sf}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        got = license_scan.scan_licenses(df).collect()
        assert len(got) == df.count()
        for r in got:
            n, at = brute_phrases(texts[r["doc_id"]])
            base = {x for _, x in at}
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), at[0][0] if at else None, at[-1][0] if at else None)
            assert r["base_labels"] == ",".join(sorted(base)) and base <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
            assert sorted(set(filter(None, r["labels"].split(",")))) == [x for x in r["labels"].split(",") if x]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, [(i, t, "en", "s") for i, t in cases])).collect()}
    n = len(license_scan.words_of(license_scan.TEMPLATES[0][1]))
    assert [(s["template"], s["first_word"], s["end_word"]) for s in got[21]["spans"]] == [("mit-text", 30, 30 + n)] and got[21]["score"] == 1
    assert "mit-notice" in got[22]["labels"] and "apache-2.0" in got[23]["labels"].split(",") and got[25]["labels"] == ""
    assert license_scan.scan_licenses(none).count() == 0


def test_chains_are_the_best_ones(monkeypatch):
    """Labels and shares against all matches and all chains, on random templates full of repeats."""
    monkeypatch.setattr(license_scan, "LEAST_WORDS", 2)
    monkeypatch.setattr(license_scan, "GAP", 3)
    rng = np.random.default_rng(21)
    word = lambda n, k=4: [chr(97 + int(x)) for x in rng.integers(0, k, n)]

    def best(text, template):
        found = []
        for i in range(len(text)):
            for j in range(len(template)):
                if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
                    n = 1
                    while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                        n += 1
                    if n >= 2:
                        found.append((i, j, n))

        def follow(x):
            most = x[2]
            for y in found:
                over = max(0, x[0] + x[2] - y[0], x[1] + x[2] - y[1])
                if y != x and y[0] >= x[0] and y[1] >= x[1] and over < y[2] and y[0] - x[0] - x[2] <= 3:
                    most = max(most, x[2] + follow(y) - over)
            return most

        return max(map(follow, found), default=0)

    for _ in range(150):
        templates = [word(int(rng.integers(2, 16))) for _ in range(3)]
        t = templates[0]
        cut = int(rng.integers(0, len(t) + 1))
        text = word(4) + t[:cut] + word(int(rng.integers(0, 4)), 6) + t[cut:] + word(5)
        got = license_scan.Scanner((), tuple((str(k), " ".join(x)) for k, x in enumerate(templates))).scan(" ".join(text))
        share = {}
        for name, a, e, r in got.spans:
            share[name] = max(share.get(name, 0), r)
        for k, x in enumerate(templates):
            n = best(text, x) / len(x)
            assert abs(share.get(str(k), 0) - (n if n >= license_scan.COVERED else 0)) < 1e-9


def test_repeated_phrases_of_a_template_are_chained():
    a, f, g = "one two three four five six".split(), [f"f{i}" for i in range(6)], [f"g{i}" for i in range(4)]
    scanner = license_scan.Scanner((), (("x", " ".join(a + f + a + g)),))
    for text in (a + f + ["new", "words"] + a + g, a + f[:3] + ["new"] + f[3:] + a + g, f[1:] + ["new"] + a + g):
        (name, first, end, share), *more = scanner.scan(" ".join(text)).spans
        assert (name, first, end, more) == ("x", 0, len(text), []) and share >= 15 / 22


def test_matching_statistics():
    rng = np.random.default_rng(9)
    word = lambda n: [bytes([97 + int(x)]) for x in rng.integers(0, 3, n)]
    for _ in range(60):
        seqs = [word(int(rng.integers(1, 14))) for _ in range(4)]
        a = license_scan.Automaton(seqs)
        text = word(40)
        inside = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        got = {i: n for i, _, n in a.statistics(text)}
        for i in range(len(text)):
            assert got.get(i, 0) == max((n for n in range(1, i + 2) if tuple(text[i - n + 1 : i + 1]) in inside), default=0)


# 7


def test_language_id(spark, odd, none, sf):
    d = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    got = gru_lid.language_id(d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    net = gru_lid.train(d)
    got = gru_lid.identify(odd.drop("score"), net).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in got} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, None: False, 7: False, 8: True}
    assert gru_lid.language_id(none).count() == 0
    assert {r["lang_pred"] for r in gru_lid.language_id(docs(spark, [(1, "abc", None, "s")])).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(gru_lid, "SAMPLE_TEXTS", 40)
    monkeypatch.setattr(gru_lid, "LEAST_TEXTS", 2, raising=False)
    rows = [(i, f"some common words {i}", "en", "s") for i in range(400)] + [(1000, "qux zyx", "rare", "s"), (None, "abc", "null", "s"), (None, "abd", "null", "s")]
    net = gru_lid.train(docs(spark, rows).where("lang is not null"))
    assert set(net.labels) == {"en", "rare", "null"}


def test_gru_gradients():
    rng = np.random.default_rng(10)
    net = gru_lid.ByteGRU(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w, y = rng.integers(97, 103, (5, 9)).astype(np.uint8), rng.integers(0, 3, 5)
    w[0, 6:] = 0
    _, g = net.gradients(w, y)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in v.shape) if k[0] != "x" else (int(rng.choice(w.reshape(-1))), int(rng.integers(0, v.shape[1])))
            old, d = v[at], 1e-3
            v[at] = old + d
            up = net.gradients(w, y)[0]
            v[at] = old - d
            down = net.gradients(w, y)[0]
            v[at] = old
            assert abs((up - down) / (2 * d) - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), (k, at)


# 8


def test_class_lm(spark, odd, none, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for few in (brown_lm.BROADCAST_WORDS, 50):
        monkeypatch.setattr(brown_lm, "BROADCAST_WORDS", few)
        monkeypatch.setattr(brown_lm, "PASSES", 2)
        for df in (d, odd):
            rows = [(r["doc_id"], [*WORDS.findall(lower(r["text"])), "\n"]) for r in df.collect()]
            held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
            c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
            n, v = sum(c.values()), len(c)
            got = brown_lm.score_texts(df).collect()
            assert len(got) == len(rows)
            want = {i: (held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in rows}
            for r in got:
                x = want[r["doc_id"]]
                assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:4]
                assert abs(r["base_score"] - x[4]) < 1e-6 * max(1, abs(x[4])) and r["score"] < 0
            if df is d:
                own = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
                assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
                if few == 50:
                    assert all(abs(r["score"] - first[r["doc_id"]]) < 0.2 * abs(first[r["doc_id"]]) for r in own)
                first = {r["doc_id"]: r["score"] for r in got}
    assert brown_lm.score_texts(none).count() == 0


def test_class_lm_scores_by_brute_force(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = [(r["doc_id"], [w.encode() for w in WORDS.findall(lower(r["text"]))]) for r in d.collect()]
    count = collections.Counter(w for i, ws in texts if not held(i) for w in (*ws, b""))
    scores = []
    for few in (brown_lm.BROADCAST_WORDS, 1500, 50):
        monkeypatch.setattr(brown_lm, "BROADCAST_WORDS", few)
        model, _ = brown_lm.fit(d.where(gru_lid.remainder(d.doc_id, 7) != 2))
        of = dict(zip(count, model.classes[model.units(list(count))]))
        k = brown_lm.CLASSES
        a, types = np.zeros((k, k)), collections.Counter(of.values())
        for i, ws in texts:
            if not held(i):
                for x, y in zip([b"", *ws], [*ws, b""]):
                    a[of[x], of[y]] += 1
        prior = (a.sum(axis=0) + 1) / (a.sum() + k)
        got = {r["doc_id"]: r["score"] for r in brown_lm.score_texts(d).collect()}
        for i, ws in texts:
            want, x = 0.0, of[b""]
            for w in (*ws, b""):
                y = of[w] if w in of else model.classes[model.units([w])[0]]
                want += math.log10((a[x, y] + brown_lm.KAPPA * prior[y]) / (a[x].sum() + brown_lm.KAPPA))
                want += math.log10((count[w] + brown_lm.BETA) / (a[:, y].sum() + brown_lm.BETA * (types[y] + 1)))
                x = y
            assert abs(got[i] - want) < 1e-6 * max(1, abs(want))
        scores.append(got)
    assert all(abs(scores[0][i] - s[i]) < 1e-6 * abs(s[i]) for s in scores for i in s)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(12)
    true = rng.integers(0, 4, 60)
    p = rng.dirichlet(np.ones(4) * 0.2, 4)
    n = rng.poisson(20 * p[true][:, true]).astype(float)
    like = lambda own: (lambda a: brown_lm._xlogx(a).sum() - brown_lm._xlogx(a.sum(0)).sum() - brown_lm._xlogx(a.sum(1)).sum())(np.eye(4)[own].T @ n @ np.eye(4)[own])
    got = brown_lm.exchange(n, 4, 20)
    start = like(np.arange(60) % 4)
    assert like(got) - start >= 0.8 * (like(true) - start)


# 9


def same_as_oracle(df, got, sql):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(sql).fetchall()
    names = [x[0] for x in con.sql(sql).description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, (tuple(r[n] for n in names) for r in got))) == sorted(map(key, want))


def test_mixing(spark, odd, none, sf):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet"), docs(spark, [(i, "w " * (i % 7), "en", "hot" if i % 3 else f"s{i % 40}") for i in range(900)])):
        got = mixing.mix(df).collect()
        assert len(got) == df.count()
        same_as_oracle(df, got, mixing.ORACLE)
        by = collections.defaultdict(list)
        for r in got:
            by[r["source"]].append(r)
        # resharing round by round, as told
        names = sorted(by, key=lambda s: (s is None, s or ""))
        size, w = {s: sum(r["size"] for r in by[s]) for s in names}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        target, left, open_ = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
        while left > 1e-9 and open_:
            share = left / sum(w[s] for s in open_)
            left = 0.0
            for s in list(open_):
                target[s] += w[s] * share
                if target[s] >= 3 * size[s]:
                    left += target[s] - 3 * size[s]
                    target[s] = 3.0 * size[s]
                    open_.discard(s)
        for s in names:
            assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["taken"] <= 3 * r["size"] for r in by[s])
            assert abs(sum(r["taken"] for r in by[s]) - target[s]) < 1 + 1e-6 * target[s]
    assert mixing.mix(none).count() == 0


# 10


def test_media(spark, odd, none, sf, tmp_path, monkeypatch):
    for k, few in enumerate((2_000_000, 0)):
        monkeypatch.setattr(media_cdc, "BROADCAST_SHARED", few)
        for j, df in enumerate((odd, spark.read.parquet(f"{sf}/documents.parquet"))):
            got = media_cdc.media_of_texts(df, f"file://{tmp_path}/{k}{j}").collect()
            texts = {r["doc_id"]: r["text"] for r in df.collect()}
            assert len(got) == df.count()
            for r in got:
                raw = (texts[r["doc_id"]] or "").encode()
                data = raw + bytes(-len(raw) % 64) if raw else bytes(64)
                assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), binascii.crc32(data[-64:]))
                media = media_cdc.wav_header(len(data)) + data
                assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert media_cdc.media_of_texts(none, f"file://{tmp_path}/none").count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(13)
    data = rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    h = 0
    rolling = []
    for b in data[:2000]:
        h = ((h << 1) + int(media_cdc._GEAR[b])) & 0xFFFFFFFF
        rolling.append(h)
    assert media_cdc.gear_hashes(np.frombuffer(data[:2000], np.uint8)).tolist() == rolling
    cut = lambda x: {media_cdc.digest(x[a:b]) for a, b in zip([0, *media_cdc.cut_points(x)], media_cdc.cut_points(x))}
    ends = media_cdc.cut_points(data)
    assert ends[-1] == len(data) and all(0 < b - a <= media_cdc.MAX for a, b in zip([0, *ends], ends))
    assert len(cut(data) & cut(b"some new start" + data)) > 0.8 * len(cut(data))
    assert media_cdc.cut_points(b"") == [] and media_cdc.cut_points(b"x" * 100) == [100]


def test_queries_run(spark, sf):
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_rare_words_take_classes_of_their_own_contexts(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "OWN_UNITS", 12)
    rng = np.random.default_rng(14)
    noun, verb = [f"n{i}x" for i in range(60)], [f"v{i}x" for i in range(60)]
    rows = [(i, " ".join(w for _ in range(12) for w in ("the", rng.choice(noun), "will", rng.choice(verb)))) for i in range(300)]
    for few in (brown_lm.BROADCAST_WORDS, 30):
        monkeypatch.setattr(brown_lm, "BROADCAST_WORDS", few)
        model, _ = brown_lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
        u = model.units([w.encode() for w in noun + verb])
        k = model.classes[u]
        assert len(set(u)) == 120 and not set(k[:60]) & set(k[60:])
