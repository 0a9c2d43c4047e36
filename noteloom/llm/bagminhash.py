"""Near-duplicate texts by BagMinHash signatures of word-shingle multisets (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import discard, join_one, lower_words, mix64, released, slices, stash
from noteloom.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
#: Two texts of similarity s agree in a band with probability s**ROWS; 1 - (1 - 0.8**5)**32 = 0.999997.
BANDS, ROWS = 32, 5
_WORD_MEMO = 250_000


class _Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= _WORD_MEMO:
            self.clear()
        self[word] = h
        return h


_hash_of = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    of = _hash_of
    return np.array([of[w] for w in words], dtype=np.uint64)


def shingle_bags(docs: list[np.ndarray], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, times it occurs there) of texts given as word hashes, sorted by document and shingle.

    A text of fewer words than a shingle is one shingle; a text without words has none.
    """
    lens = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.concatenate(docs) if len(docs) else np.array([], np.uint64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    n = np.where(lens >= words, lens - words + 1, 0)
    doc = np.repeat(np.arange(len(docs)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    for k in range(words):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + flat[at + k] + np.uint64(k + 1))
    short = np.nonzero((lens > 0) & (lens < words))[0]
    if len(short):
        extra = []
        for i in short:
            x = np.zeros(1, np.uint64)
            for k, w in enumerate(docs[i]):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(k + 1))
            extra.append(x[0])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(extra, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))[0] if len(doc) else np.array([], np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(doc)))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIDES = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _exponentials(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)


def bag_signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """One row of `size` minima for each document; two rows agree in a place with the weighted Jaccard's probability.

    Weights lie on the levels 0, 1, 2, ...: a Poisson process of rate 1 stands for each (shingle, level) up to the
    weight, and its points hit places of the signature at random. The hierarchy: the levels [2**k, 2**(k+1)) share
    one process, whose first point is the first of all of theirs. Only while it comes before the signature's largest
    value is the process split in halves: one, by a fair bit, has that point as its first, the other draws its own;
    halves above the weight are dropped. All draws hang on shingle and levels alone, so equal shingles have equal
    points at equal levels in all documents, and a place's minimum is common to two documents with probability
    (sum of smaller weights) / (sum of larger weights).
    """
    sig = np.full((n_docs, size), np.inf)
    flat, limit = sig.reshape(-1), np.full(n_docs, np.inf)
    roots = [(np.arange(len(doc)), 0, 1)]
    k = 1
    while len(doc) and (at := np.nonzero(weight > k)[0]).size:
        roots.append((at, k, k))
        k *= 2
    row = np.concatenate([r[0] for r in roots])
    low = np.concatenate([np.full(len(r[0]), r[1]) for r in roots])
    width = np.concatenate([np.full(len(r[0]), r[2]) for r in roots])
    d, w = doc[row], weight[row]
    state = mix64(shingle[row] ^ mix64(low.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)))
    tag, drawn = mix64(state + _STEP), np.ones(len(row), np.uint64)
    when = _exponentials(tag) / width
    while len(d):
        live = when < limit[d]
        d, w, low, width, state, tag, drawn, when = (x[live] for x in (d, w, low, width, state, tag, drawn, when))
        if not len(d):
            break
        whole = low + width <= w
        np.minimum.at(flat, d[whole] * size + (tag[whole] % np.uint64(size)).astype(np.int64), when[whole])
        unit = width == 1
        i, j = np.nonzero(unit)[0], np.nonzero(~unit)[0]
        if len(i):  # a level by itself: its next points, several at once where few processes are left
            n = max(1, min(32, 8192 // len(i)))
            bits = mix64(state[i, None] + _STEP * (drawn[i, None] + np.arange(1, n + 1, dtype=np.uint64)))
            t = when[i, None] + np.cumsum(_exponentials(bits), axis=1)
            if n > 1:
                np.minimum.at(flat, (d[i, None] * size + (bits % np.uint64(size)).astype(np.int64)).reshape(-1), t.reshape(-1))
            tag[i], when[i] = bits[:, -1], t[:, -1]
            drawn[i] += np.uint64(n)
        if len(j):
            half = width[j] // 2
            side = (state[j] >> np.uint64(63)).astype(np.int64)
            other = mix64(state[j] ^ _SIDES[1 - side])
            first = mix64(other + _STEP)
            state[j] = mix64(state[j] ^ _SIDES[side])
            olow, owhen = low[j] + (1 - side) * half, when[j] + _exponentials(first) / half
            low[j] += side * half
            width[j], drawn[j] = half, 0
            add = (d[j], w[j], olow, half, other, first, np.ones(len(j), np.uint64), owhen)
            d, w, low, width, state, tag, drawn, when = (np.concatenate(x) for x in zip((d, w, low, width, state, tag, drawn, when), add))
            keep = low < w
            d, w, low, width, state, tag, drawn, when = (x[keep] for x in (d, w, low, width, state, tag, drawn, when))
        limit = sig.max(axis=1)
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = mix64(sig.view(np.uint64)).reshape(len(sig), bands, rows)
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1), len(sig), axis=0)
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return out.view(np.int64)


BITS = 1024


def bit_sets(doc: np.ndarray, shingle: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the 1024-bit set of its shingles' hashes, as 16 longs: a bit that only one of two documents
    has is a shingle that the other lacks."""
    has = np.zeros((n_docs, BITS), bool)
    has[doc, (shingle % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(has, axis=1, bitorder="little").view(np.int64)


def spare(total: Column, bits: Column) -> Column:
    """How many of a document's shingle occurrences its bit set does not count: at most so many, beside the bits in
    common, can it share with another."""
    return total - sum((F.bit_count(bits[k]) for k in range(BITS // 64)), F.lit(0))


def may_reach(a: str, b: str, threshold: float = THRESHOLD, spares: tuple[Column, Column] | None = None) -> Column:
    """Whether the bound that weights and bit sets put on two documents' similarity reaches the threshold.

    No more occurrences are in common than the common bits and the smaller spare number. A join gives the spare
    numbers as columns of its sides and each bit set is named once, which keeps the condition's code short.
    """
    ra, rb = spares or (spare(F.col(f"n{x}"), F.col(f"b{x}")) for x in (a, b))
    least = (threshold - 1e-9) / (1 + threshold - 1e-9)
    common = sum((F.bit_count(F.col(f"b{a}")[k].bitwiseAND(F.col(f"b{b}")[k])) for k in range(BITS // 64)), F.lit(0))
    return common + F.least(ra, rb) >= least * (F.col(f"n{a}") + F.col(f"n{b}"))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags given as sorted shingles and counts."""
    i = np.searchsorted(b[0], a[0])
    i[i == len(b[0])] = 0
    same = b[0][i] == a[0]
    least = np.minimum(a[1][same], b[1][i[same]]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in slices(big, 1, 512, 1_000_000):
            words = [lower_words(t.as_py()) for t in b.column(1)]
            same = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
            docs = [word_hashes(w) for w in words]
            doc, h, n = shingle_bags(docs)
            keys = band_keys(bag_signatures(doc, h, n, len(docs)))
            total = np.bincount(doc, n, len(docs)).astype(np.int64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array([k.tolist() if s else [] for k, s in zip(keys, same)], longs), pa.array(total), pa.array(list(bit_sets(doc, h, len(docs))), longs)], names=["id", "same", "bands", "total", "bits"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts that reach the threshold. A row without v brings the text of u for the rows that follow it."""
    last_id, last = None, None

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        _, h, n = shingle_bags([word_hashes(lower_words(text))])
        return h, n

    for b in batches:
        us, vs = [], []
        for u, v, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if v is None:
                last_id, last = u, bag(text.as_py())
            elif last_id != u:
                raise ValueError("a text came before the one that it is held against")
            elif overlap(last, bag(text.as_py())) >= THRESHOLD:
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


#: A text meets so many others at a time, and two blocks of about TILE texts of a bucket make one group of the pair join.
CHUNK, TILE = 128, 256


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v, n) whose texts reach the threshold; n is about how many partners u has. Each group of about
    CHUNK partners gets the text of u once, so neither a large bucket's texts nor its first one gather in one task."""
    pairs = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.expr(f"1 + n div {CHUNK}")).alias("part"))
    text_of = lambda x: texts.select(F.col("id").alias(x), "text")
    heads = pairs.select("u", "part").distinct().join(text_of("u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    rows = heads.unionByName(pairs.join(text_of("v"), "v").select("u", "part", "v", "text"))
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return rows.select("u", "v", "text").mapInArrow(released(_verify, _hash_of), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts linked by a weighted Jaccard of 0.8 or more of their five-word shingles.

    Returns one row per input row: id, component_id (the smallest id of the class, reached by links) and kept
    (id = component_id). Words are runs without white space, A-Z lower-cased. Texts with the same words are one
    class; a text of fewer than five words is one shingle; a null text or one without words links with nothing. A
    row with a null id links with nothing: component_id null, kept true. Rows that share an id are one document.
    Other columns are ignored; an empty table gives no rows.

    Rows that share an id but not their words are linked by the words of each where they are equal to another
    text's, and otherwise by the smallest of their texts.

    One pass over the texts gives each row the digest of its words and its band keys; copies meet by digest. In
    each band a text is paired with the bucket's smallest one and the pair verified on the whole bags: as many
    pairs as rows, however large the bucket. Buckets that then still hold several classes are settled exactly: all
    pairs of their texts across classes are verified too, block by block, but for those that a bound from weights and
    bit sets rules out inside the join. Pairs within a class cannot change it and are left out.
    """
    signed = stash(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(_sign, _hash_of), "id long, same binary, bands array<long>, total long, bits array<long>"), "op4-signed")
    usable = signed.where("id is not null and same is not null")
    firsts = usable.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("bands", "total", "bits")])
    firsts = stash(firsts, "op4-distinct")
    copies = join_one(usable.select("same", "id"), firsts.select("same", "first", "n").where("n > 1"), "same", "n").select(F.col("id").alias("u"), F.col("first").alias("v"))
    banded = firsts.select(F.col("first").alias("id"), F.explode("bands").alias("band"))
    heads = stash(banded.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("tail"), F.count("*").alias("n")).where("head < tail").select("band", "head", "n", F.col("n").alias("size")), "op4-heads")
    buckets = stash(join_one(banded, heads, "band", "n"), "op4-buckets")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    members = buckets.select("id").distinct()
    texts = stash(texts.join(members, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "op4-texts")
    tried = stash(buckets.where("id <> head").groupBy(F.col("head").alias("u"), F.col("id").alias("v")).agg(F.max("size").alias("n")), "op4-tried")
    stars = stash(_linked(tried, texts), "op4-stars")
    known = components(stars)
    classed = buckets.join(known.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("class"))
    mixed = classed.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mixed = stash(mixed.select("band", "n", F.expr(f"1 + n div {TILE}").alias("blocks")), "op4-mixed")
    open_ = stash(join_one(classed, mixed, "band", "n"), "op4-open")
    bounds = firsts.select(F.col("first").alias("id"), "total", "bits", "bands", spare(F.col("total"), F.col("bits")).alias("spare"))
    of = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(bounds, "id")

    def side(x: str, lo: Column, hi: Column, other: Column) -> DataFrame:
        return of.withColumn("other", F.explode(other)).select("band", lo.alias("lo"), hi.alias("hi"), F.col("id").alias(x), F.col("class").alias(f"c{x}"), F.col("total").alias(f"n{x}"), F.col("spare").alias(f"r{x}"), F.col("bits").alias(f"b{x}"), F.col("bands").alias(f"s{x}"))

    block, other = F.col("block"), F.col("other")
    left, right = side("u", block, other, F.sequence(block, F.col("blocks") - 1)), side("v", other, block, F.sequence(F.lit(0).cast("long"), block))
    # of the buckets that two texts share, only the first makes the pair; a block meets itself once
    once = F.array_min(F.array_intersect("su", "sv")) == F.col("band")
    across = (F.col("cu") < F.col("cv")) | (F.col("cu") > F.col("cv")) & (F.col("lo") < F.col("hi"))
    rest = left.join(right, ["band", "lo", "hi"]).where(across & may_reach("u", "v", spares=(F.col("ru"), F.col("rv"))) & once)
    rest = stash(rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"), "op4-rest")
    partners = stash(rest.groupBy("u").agg(F.count("*").alias("n"), F.count("*").alias("k")), "op4-partners")
    more = stash(_linked(join_one(rest, partners, "u", "k"), texts), "op4-more")
    discard(buckets, heads, texts, tried, mixed, open_, rest, partners)
    comp = components(stars.unionByName(more).unionByName(copies))
    out = signed.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"))
    out = stash(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "op4-classes")
    discard(signed, firsts, stars, more)
    return out
