"""Each stage of the corpus pipeline on its own input, against brute-force versions."""

import collections
import hashlib
import re

import corpus_pipeline as P
import public_tokenizers
import tiktoken

from noteloom.llm import bpe, mixing
from noteloom.llm.common import stash


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def times(docs):
    """How often the mix takes each document whole: those whose middle lies in the budget, by hash key."""
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    by = collections.defaultdict(list)
    for r in docs.collect():
        key = md5(f"{'null' if r['doc_id'] is None else r['doc_id']} {md5(r['text'] or '')}")
        by[r["source"]].append((key, r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    out = collections.Counter()
    for s, rows in by.items():
        whole = sum(n for *_, n in rows)
        epochs = int(target[s] // whole) if whole else 0
        at = 0
        for _, i, n in sorted(rows, key=lambda r: (r[0], str(r[1]))):
            out[i] += epochs + (n > 0 and epochs < 3 and at + n / 2 <= target[s] - epochs * whole)
            at += n
    return +out


def odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    same = [(None, "one row that many share without an id of its own", "en", "src0", 3)] * 40
    ids = [(7_000_000, f"text number {i} under an id that many rows share, with words {i * 7} and {i * 11}", "en", "src1", 4) for i in range(30)]
    return docs.unionByName(spark.createDataFrame(same + ids + [(None, None, None, None, None), (None, "", "en", "src0", 0)], docs.schema))


def test_mixing_of_equal_rows_and_shared_ids(spark, sf):
    docs = stash(odd_rows(spark, sf), "test")
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == times(docs)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_rows(docs).collect()))
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_whole_pipeline(spark, sf, tmp_path, monkeypatch):
    """run() over odd rows: every document that is kept is one of its class, and its ids are those of its text."""
    odd_rows(spark, sf).write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if r["doc_id"] != 7_000_000}
    got = P.run(spark, str(tmp_path)).collect()
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert got and all(r["ids"] == codec.encode_ordinary(docs[r["doc_id"]]) for r in got if r["doc_id"] in docs and r["doc_id"] is not None)
    count = collections.Counter(r["doc_id"] for r in got)
    assert all(n <= 3 for i, n in count.items() if i is not None) and count[7_000_000] <= 3
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 %%", "en", None, 5), (10**6 + 2, "twice here is a row of its own", "en", "src2", 30), (10**6 + 2, "twice here is a row of its own", "en", "src2", 30)], docs.schema)
    docs = stash(docs.unionByName(odd), "test")
    columns = docs.columns

    kept = stash(P.language(spark, docs, sf), "test")
    assert kept.columns == columns
    want = {r["doc_id"] for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    assert {r["doc_id"] for r in kept.collect()} == want

    once = stash(P.near_duplicates(spark, kept, sf), "test")
    assert once.columns == columns
    bags = [(r["doc_id"], bag(r["text"])) for r in kept.collect()]
    least = {i: i for i, _ in bags}
    for _ in range(4):
        for i, a in bags:
            for j, b in bags:
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    least[i] = min(least[i], least[j])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(least.values()))

    mixed = stash(P.mix(spark, once, sf), "test")
    assert mixed.columns == columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == times(once)

    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    got = P.encode(spark, mixed, sf).collect()
    assert len(got) == mixed.count()
    for r in got:
        assert r["ids"] == codec.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
