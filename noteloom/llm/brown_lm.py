"""Text scores by a class-based bigram model with Brown classes (operator 8)."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import gathered, released, small_batches, stash
from noteloom.llm.gru_lid import remainder

#: Words that occur so often are units of the clustering by themselves, however many they are; all others go in groups by
#: their last bytes. The OWN_UNITS most frequent are exchanged one by one on the driver, the other ones in rounds in Spark.
OWN_COUNT, OWN_UNITS, GROUPS, CLASSES = 10, 1000, 152, 48
#: Rounds over the words' contexts end when a sweep over all words gains no more than TOLERANCE nats a token (or PASSES are over, if set).
TOLERANCE, PASSES = 1e-4, None
#: Words whose counts every executor gets; the counts of all others meet their texts in a join.
BROADCAST_WORDS = 200_000
KAPPA, BETA = 5.0, 0.5
END = b""
_FLUSH, _MEMO = 600_000, 400_000
#: Contexts go in parts of about PART_TOKENS tokens, written in packs of whole words of PACK entries or more; BLOCK cells make a part.
_TOKENS, PART_TOKENS, PACK, BLOCK = 2_000_000, 1_000_000, 16_384, 8192
_ROWS, _BYTES = 2000, 4_000_000  # of texts that are split at once


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


def hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), np.uint64)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int = CLASSES, passes: int | None = None, start: np.ndarray | None = None, still: int = 0) -> np.ndarray:
    """Classes of units from their bigram counts n[left, right]: each unit in turn moves to the class that raises the
    likelihood of the class bigram model most, until a pass moves none (or passes are over). Frequent units go first;
    ties keep or take the smaller class. The last still units stay where start has them."""
    units = len(n)
    freq = n.sum(axis=1) + n.sum(axis=0)
    order = np.argsort(-freq, kind="stable")
    own = np.empty(units, np.int64)
    own[order] = np.arange(units) % classes
    if start is not None:
        own[:] = start
    order = order[order < units - still]
    one = np.eye(classes)
    a = np.zeros((classes, classes))
    np.add.at(a, (own[:, None], own[None, :]), n)
    left, right = n.sum(axis=1), n.sum(axis=0)
    cl, cr = one[own].T @ left, one[own].T @ right
    for _ in itertools.count() if passes is None else range(passes):
        moved = 0
        for u in order:
            if not freq[u]:
                break
            k0 = own[u]
            r = np.bincount(own, n[u], classes)
            c = np.bincount(own, n[:, u], classes)
            s = n[u, u]
            r[k0] -= s
            c[k0] -= s
            a[k0] -= r
            a[:, k0] -= c
            a[k0, k0] -= s
            cl[k0] -= left[u]
            cr[k0] -= right[u]
            base = _xlogx(a)
            rows, cols = _xlogx(a + r) - base, _xlogx(a + c[:, None]) - base
            diag = np.diag(a)
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + _xlogx(diag + r + c + s) - _xlogx(diag)
            gain -= _xlogx(cl + left[u]) - _xlogx(cl) + _xlogx(cr + right[u]) - _xlogx(cr)
            k = int(gain.argmax())
            if gain[k] <= gain[k0] + 1e-9:
                k = k0
            moved += k != k0
            own[u] = k
            a[k] += r
            a[:, k] += c
            a[k, k] += s
            cl[k] += left[u]
            cr[k] += right[u]
        if not moved:
            break
    return own


def likelihood(a: np.ndarray) -> float:
    """What the classes decide of the log likelihood, from class bigram counts."""
    return float(_xlogx(a).sum() - _xlogx(a.sum(axis=0)).sum() - _xlogx(a.sum(axis=1)).sum())


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words without white space of all texts, A-Z lower-cased; how many each text has). Arrow cuts at space and 09 to 0D."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, lens = lists.flatten(), lists.value_lengths().to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # an end with white space gives an empty word
    upto = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    ends = np.cumsum(lens)
    return flat.filter(full).cast(pa.binary()), upto[ends] - upto[ends - lens]


class _Codes(dict):
    """Codes of words that are not frequent, as they are met; forgotten when many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> int:
        m = self.model
        unit = 1 + group_of(word)
        if len(m.far):
            h = hashes([word])[0]
            k = int(np.searchsorted(m.far, h))
            if k < len(m.far) and m.far[k] == h:
                unit = 1 + GROUPS + len(m.unit) + k
        if len(self) >= _MEMO:
            self.clear()
        self[word] = len(m.unit) + unit
        return len(m.unit) + unit


@dataclass
class Model:
    """What scoring needs besides the counts of rare words. Units: 0 the end, then groups, words, and far words."""

    words: pa.Array  # frequent ones, the end among them: rows of count and unit
    count: np.ndarray
    unit: np.ndarray
    far: np.ndarray  # sorted hashes of the other words that are units by themselves
    n_tokens: int
    n_types: int
    classes: np.ndarray | None = None  # by unit
    step: np.ndarray | None = None  # log10 P(class | class before)
    lost: np.ndarray | None = None  # log10 of the emission's divisor, by class

    def codes(self, words: pa.Array) -> np.ndarray:
        """The row of each frequent word; of the others, the number of rows and the unit."""
        if "_codes" not in self.__dict__:
            self._codes = _Codes(self)
        seen = words.dictionary_encode()
        of = pc.fill_null(pc.index_in(seen.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        rare = np.nonzero(of < 0)[0]
        if len(rare):
            of[rare] = [self._codes[w] for w in seen.dictionary.take(pa.array(rare)).to_numpy(zero_copy_only=False)]
        return of[seen.indices.to_numpy()]

    def text_codes(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(words of all texts; codes of all, with an end after each text; place of each word among them; ends)."""
        words, n = split_words(texts)
        ends = np.cumsum(n + 1)
        place = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
        codes = np.full(len(words) + len(n), self.codes(pa.array([END], pa.binary()))[0])
        codes[place] = self.codes(words)
        return words, codes, place, ends

    def unit_of(self) -> np.ndarray:
        """The unit of each code; the end is one wherever it stands."""
        return np.concatenate([self.unit, np.arange(1 + GROUPS + len(self.unit) + len(self.far))])

    def units(self, words: list[bytes]) -> np.ndarray:
        return self.unit_of()[self.codes(pa.array(words, pa.binary()))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codes"}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    kind = pa.schema([("w", pa.binary()), ("n", pa.int64())])

    def summed() -> pa.Table:
        got = pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("n", "sum")])
        return pa.table([got["w"], got["n_sum"]], schema=kind)

    for b in gathered(batches, 0, _ROWS, _BYTES):
        words, n = split_words(b.column(0))
        seen = words.value_counts()
        held.append(pa.table([seen.field(0), seen.field(1)], schema=kind))
        held.append(pa.table([[END], [len(n)]], schema=kind))
        rows += len(seen) + 1
        if rows > _FLUSH:
            held = [summed()]
            rows = held[0].num_rows
            if rows > _FLUSH // 2:
                yield from held.pop().to_batches(max_chunksize=100_000)
                rows = 0
    if held:
        yield from summed().to_batches(max_chunksize=100_000)


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(w, n) over all texts; the empty word stands for the end of a text."""
    return df.select(text_col).mapInArrow(released(_count), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(hashes(words).view(np.int64)), pa.array([group_of(w) for w in words], pa.int16())], names=["h", "g"])


_KEYS = "part int, keys binary, n binary"
_PACK = "part int, w binary, lens binary, o binary, n binary"


def _packed(schema: str, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a number and arrays."""
    names = [f.split()[0] for f in schema.split(", ")]
    for part, *arrays in rows:
        cols = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in arrays]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *cols], names=names)


def _squeeze(runs: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts (None: each counts 1)."""
    keys = np.concatenate([k for k, _ in runs])
    if all(n is None for _, n in runs):
        return np.unique(keys, return_counts=True)
    n = np.concatenate([np.ones(len(k), np.int64) if n is None else n for k, n in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.nonzero(np.diff(keys, prepend=keys[:1] - 1))[0]
    return keys[new], np.add.reduceat(n[order], new)


def _split(shared, suffix, first: int, parts: int):
    """Texts to packed (part, keys, n).

    Parts below 0 count bigrams of units before first (the far ones put into a second set of their groups), in blocks
    of cells. The others have the contexts of the words from first on: key = word << 32 | neighbour << 2 | side, where
    side is 0 for a word that follows, 1 for a far word and 2 for another one that comes before.
    """
    size = first + GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, near = shared.value, suffix.value
        unit = model.unit_of()
        held, rows, cells = [], 0, np.zeros(size * size, np.int64)

        def out() -> Iterator[tuple[int, np.ndarray, None]]:
            u = unit[np.concatenate(held)]
            held.clear()
            s = near[u]
            s, t = np.concatenate([[0], s[:-1]]), s  # before a text's first word stands the end, as after its last one
            cells[:] += np.bincount(s * size + t, minlength=size * size)
            l, r = np.concatenate([[0], u[:-1]]), u
            a, b = np.nonzero(l >= first)[0], np.nonzero(r >= first)[0]
            before = l[b]
            w = np.concatenate([l[a], r[b]])
            o = np.concatenate([r[a] << 2, (before << 2) + np.where(before >= first, 1, 2)])
            part = (_spread(w) % parts).astype(np.uint16 if parts < 2**16 else np.int64)  # short numbers are sorted faster
            order = np.argsort(part, kind="stable")
            part, keys = part[order], (w << 32 | o)[order]
            cut = np.nonzero(np.diff(part.astype(np.int64), prepend=-1))[0]
            for lo, hi in zip(cut, [*cut[1:], len(part)]):
                yield int(part[lo]), keys[lo:hi], None

        for b in gathered(batches, 0, _ROWS, _BYTES):
            held.append(model.text_codes(b.column(0))[1])
            rows += len(held[-1])
            if rows > _TOKENS:
                yield from _packed(_KEYS, out())
                rows = 0
        if held:
            yield from _packed(_KEYS, out())
        at = np.nonzero(cells)[0]
        for lo in range(0, size * size, BLOCK):
            x = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + BLOCK)]
            if len(x):
                yield from _packed(_KEYS, [(-1 - lo // BLOCK, x, cells[x])])

    return run


def _spread(w: np.ndarray) -> np.ndarray:
    return (w * 2654435761 & 0xFFFFFFFF) >> 8


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's keys once; contexts in packs of whole words."""
    runs: dict[int, list] = {}
    fresh: Counter = Counter()
    for b in batches:
        for part, keys, n in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(part, []).append((np.frombuffer(keys, np.int64), None if n is None else np.frombuffer(n, np.int64)))
            fresh[part] += len(keys) // 8
            if fresh[part] > 8_000_000:
                runs[part] = [_squeeze(runs[part])]
                fresh[part] = 0
    for part in sorted(runs):
        keys, n = _squeeze(runs.pop(part))
        if part < 0:
            yield from _packed(_PACK, [(part, keys, None, None, n)])
            continue
        w, o = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
        word = np.nonzero(np.diff(w, prepend=-1))[0]
        w, lens = w[word].astype(np.int32), np.diff(np.append(word, len(keys))).astype(np.int32)
        cut = np.unique(np.minimum(np.searchsorted(word, np.arange(0, len(keys), PACK)), len(word) - 1))
        small = n.astype(np.uint16) if n.max() < 2**16 else n
        for lo, hi in zip(cut, [*cut[1:], len(word)]):
            at = slice(word[lo], word[hi] if hi < len(word) else len(keys))
            yield from _packed(_PACK, [(part, w[lo:hi], lens[lo:hi], o[at], small[at])])


def _unpack(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(words, how many entries each has, the entries' neighbours << 2 | sides, their counts) of packs."""
    w, lens, o, n = ([x.as_buffer() for x in b.column(k)] for k in range(4))
    o = [np.frombuffer(x, np.uint32) for x in o]
    n = [np.frombuffer(x, np.uint16 if x.size == 2 * len(y) else np.int64) for x, y in zip(n, o)]
    return *(np.concatenate([np.frombuffer(x, np.int32) for x in c]).astype(np.int64) for c in (w, lens)), np.concatenate(o), np.concatenate(n)


def _summed(contexts: DataFrame, run) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) that tasks give, x summed for each i."""
    with small_batches(contexts.sparkSession, 64):
        got = contexts.select("w", "lens", "o", "n").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    return got["i"].to_numpy(), got["x"].to_numpy()


def _pairs(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(x.astype(np.float64))], names=["i", "x"])


def _round(contexts: DataFrame, classes: np.ndarray, half: np.ndarray, turn: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass over all contexts.

    (class bigrams that hold a word of the contexts, what the moves change of them as long as neighbours stay, units
    that move, their classes). The words of one half move, each to the class that fits its neighbours' classes best.
    """
    fit = np.log(a + BETA)
    row, col = np.log(a.sum(axis=1) + BETA * CLASSES), np.log(a.sum(axis=0) + BETA * CLASSES)
    shared = contexts.sparkSession.sparkContext.broadcast((classes, half, fit, row, col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, half, fit, row, col = shared.value
        sums = np.zeros((2, CLASSES, CLASSES))
        place = (np.arange(4) * CLASSES + own[:, None]).astype(np.uint8).reshape(-1)  # of an entry among its word's
        for b in batches:
            if not b.num_rows:
                continue
            w, lens, o, n = _unpack(b)
            at = np.repeat(np.arange(len(w)) * (3 * CLASSES), lens)
            at += place[o]
            m = np.bincount(at, n, len(w) * 3 * CLASSES).reshape(len(w), 3, CLASSES)
            after, before, k0 = m[:, 0], m[:, 1] + m[:, 2], own[w]
            np.add.at(sums[0], k0, after)
            np.add.at(sums[0].T, k0, m[:, 2])
            gain = after @ fit.T + before @ fit - after.sum(axis=1)[:, None] * row - before.sum(axis=1)[:, None] * col
            k = gain.argmax(axis=1)
            i = np.arange(len(w))
            go = (gain[i, k] > gain[i, k0] + 1e-6) & (half[w] == turn)
            np.add.at(sums[1], k[go], after[go])
            np.subtract.at(sums[1], k0[go], after[go])
            np.add.at(sums[1].T, k[go], before[go])
            np.subtract.at(sums[1].T, k0[go], before[go])
            yield _pairs(2 * CLASSES**2 + w[go], k[go])
        yield _pairs(np.arange(2 * CLASSES**2), sums.reshape(-1))

    i, x = _summed(contexts, run)
    shared.unpersist()
    sums = np.zeros(2 * CLASSES**2)
    cell = i < len(sums)
    sums[i[cell]] = x[cell]
    now, change = sums.reshape(2, CLASSES, CLASSES)
    return now, change, i[~cell] - len(sums), x[~cell].astype(np.uint8)


def _far_cells(contexts: DataFrame, classes: np.ndarray, first: int) -> np.ndarray:
    """Bigram counts of the units before first and the classes of all other words, as far as contexts hold them."""
    size = first + CLASSES
    shared = contexts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = shared.value, np.zeros(size * size)
        for b in batches:
            if not b.num_rows:
                continue
            w, lens, o, n = _unpack(b)
            me, side, o = np.repeat(first + own[w].astype(np.int64), lens), o & 3, (o >> 2).astype(np.int64)
            it = np.where(o < first, o, first + own[o].astype(np.int64))
            once = side != 1  # a pair of far words counts where the second one follows
            sums += np.bincount(np.where(side == 0, me * size + it, it * size + me)[once], n[once], size * size)
        at = np.nonzero(sums)[0]
        for lo in range(0, len(at), 100_000):
            yield _pairs(at[lo : lo + 100_000], sums[at[lo : lo + 100_000]])

    i, x = _summed(contexts, run)
    shared.unpersist()
    out = np.zeros(size * size)
    out[i] = x
    return out.reshape(size, size)


def cluster(contexts: DataFrame, cells: np.ndarray, suffix: np.ndarray, half: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts).

    Units before first are exchanged one by one, with the others put into their suffix's group; the others start with
    its class, then move in rounds by the classes of all their own neighbours, half of them at a time, until a sweep
    gains no more than TOLERANCE; then the first ones are exchanged again. A round whose likelihood is below the best
    one is taken back.
    """
    alone = cells[:first, :first]
    fold = np.concatenate([np.arange(first), 1 + np.arange(GROUPS)])
    n = np.zeros((first, first))
    np.add.at(n, (fold[:, None], fold[None, :]), cells)
    got = exchange(n)
    classes = got[np.where(suffix < first, suffix, suffix - first + 1)].astype(np.uint8)
    a = _folded(n, got)
    if len(suffix) > first:
        fixed, tokens = _folded(alone, got), max(a.sum(), 1)
        best, kept, at_best, before = likelihood(a), classes, a, -np.inf
        for k in itertools.count() if PASSES is None else range(2 * PASSES + 1):
            now, change, w, to = _round(contexts, classes, half, k % 2, a)
            exact = fixed + now
            if k and likelihood(exact) <= best:
                classes, a = kept, at_best
            else:
                best, kept, at_best = likelihood(exact), classes, exact
                classes, a = classes.copy(), np.maximum(exact + change, 0)
                classes[w] = to
            if k % 2 == 0:
                if best - before <= TOLERANCE * tokens:
                    break
                before = best
        classes = kept
        n = _far_cells(contexts, classes, first)
        n[:first, :first] += alone
        got = exchange(n, start=np.concatenate([classes[:first], np.arange(CLASSES)]), still=CLASSES)
        classes[:first] = got[:first]
        a = _folded(n, got)
    return classes, a


def _folded(n: np.ndarray, own: np.ndarray) -> np.ndarray:
    one = np.eye(CLASSES)[own]
    return one.T @ n @ one


def _frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """(words, counts) of all words that occur c times or more, c being the least that leaves no more than
    BROADCAST_WORDS; and of the OWN_UNITS + 1 most frequent words in any case. Most frequent first, ties by the word."""
    hist = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(BROADCAST_WORDS + 1).collect()
    least, sum_ = None, 0
    for r in hist:
        sum_ += r["k"]
        if sum_ > BROADCAST_WORDS:
            break
        least = r["n"]
    got = [] if least is None else [(r["n"], r["w"]) for r in counts.where(F.col("n") >= least).toLocalIterator()]
    if len(got) < OWN_UNITS + 1:
        rest = counts if least is None else counts.where(F.col("n") < least)
        got += [(r["n"], r["w"]) for r in rest.orderBy(F.desc("n"), "w").limit(OWN_UNITS + 1 - len(got)).collect()]
    got.sort(key=lambda x: (-x[0], x[1]))
    return [bytes(w) for _, w in got], np.array([n for n, _ in got], np.int64)


def fit(train: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the texts given, and the table of all word counts."""
    spark = train.sparkSession
    counts = stash(word_counts(train, text_col), "op8-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") >= OWN_COUNT).cast("long")).alias("own")).first()
    top, count = _frequent(counts)
    group = np.array([group_of(w) for w in top], np.int64)
    unit = np.where(count >= OWN_COUNT, 1 + GROUPS + np.arange(len(top)), 1 + group).astype(np.int64)
    if END in top:
        unit[top.index(END)] = 0
    own = int((count >= OWN_COUNT).sum())
    alone = min(OWN_UNITS + 1, own)
    first = 1 + GROUPS + alone
    # where each unit's bigrams are counted at first: by itself, or in the second set of groups
    suffix, side = [np.arange(first), first + group[alone:]], [np.zeros(1 + GROUPS, np.uint8), (hashes(top) & 1).astype(np.uint8)]
    far = np.zeros(0, np.uint64)
    if own < (total["own"] or 0):
        rest = counts.where(F.col("n") >= OWN_COUNT).where(F.col("n") <= int(count[-1]))
        got = rest.select("w").mapInArrow(_far, "h long, g short").toArrow()
        h, at = np.unique(got["h"].to_numpy().view(np.uint64), return_index=True)
        fresh = ~np.isin(h, hashes(top))
        far, at = h[fresh], at[fresh]
        suffix.append(first + got["g"].to_numpy()[at].astype(np.int64))
        side.append((far & 1).astype(np.uint8))
    suffix, side = np.concatenate(suffix), np.concatenate(side)
    model = Model(pa.array(top, pa.binary()), count, unit, far, int(total["n"] or 0), int(total["v"] or 0))
    shared, near = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(suffix)
    parts = max(1, model.n_tokens // PART_TOKENS)
    split = train.select(text_col).mapInArrow(released(_split(shared, near, first, parts)), _KEYS)
    grams = stash(split.repartition(parts + 1, "part").mapInArrow(released(_merge), _PACK), "op8-contexts", rows=64)
    cells = np.zeros((first + GROUPS) ** 2)
    for r in grams.where("part < 0").toLocalIterator():
        cells[np.frombuffer(r["w"], np.int64)] = np.frombuffer(r["n"], np.int64)
    model.classes, a = cluster(grams.where("part >= 0"), cells.reshape(first + GROUPS, -1), suffix, side, first)
    prior = (a.sum(axis=0) + 1) / (a.sum() + CLASSES)
    model.step = np.log10((a + KAPPA * prior) / (a.sum(axis=1, keepdims=True) + KAPPA))
    # distinct words of each class, over the whole table
    by_unit = spark.sparkContext.broadcast(model.classes)
    types = counts.select(F.col("w")).mapInArrow(_types(shared, by_unit), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(CLASSES)
    for r in types:
        v[r["k"]] = r["v"]
    model.lost = np.log10(a.sum(axis=0) + BETA * (v + 1))
    return model, counts


def _types(shared, by_unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, by_code = np.zeros(CLASSES, np.int64), by_unit.value[shared.value.unit_of()]
        for b in batches:
            v += np.bincount(by_code[shared.value.codes(b.column(0))], minlength=CLASSES)
        at = np.nonzero(v)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(v[at])], names=["k", "v"])

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """log10 probabilities of every whole text under the unigram base and under the class model.

    Returns one row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity
    (10 ** (-score / n_tokens)). Rows that are not held out (crc32(id) mod 7 is not 2) train. Tokens are the words
    without white space, A-Z lower-cased, and one end. A null text is empty: one token. A null id's crc32 is the
    empty text's. Repeated rows are rows like any other; other columns are ignored; an empty table gives no rows,
    and without training rows counts are 0.

    The model: exchange clustering gives every word a class, all that occur OWN_COUNT times or more by themselves, from
    the counts of their own contexts, and rarer ones with their group; a text's probability is the product of class transitions, smoothed by the classes' shares,
    and of a word's share in its class, smoothed for unseen words. All counts cover all training texts. Counts of
    the most frequent words go to every executor; those of all others come by an equi-join of the words that each
    text has, added to its sums.
    """
    held = held_out if held_out is not None else F.coalesce(remainder(F.col(id_col), 7) == 2, F.lit(False))
    model, counts = fit(df.where(~held), text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, unit = len(m.count), m.unit_of()
        classes = m.classes[unit]
        # by code; a word that no executor has counts as none that occurs, and the join adds what it lacks
        count = np.concatenate([m.count, np.zeros(len(unit) - known)])
        base, own = np.log10(count + 1.0) - np.log10(m.n_tokens + m.n_types + 1.0), np.log10(count + BETA) - m.lost[classes]
        step, border = m.step.reshape(-1), int(m.classes[0])
        for b in gathered(batches, 2, _ROWS, _BYTES):
            words, code, place, ends = m.text_codes(b.column(2))
            at = np.append(0, ends[:-1])
            k = classes[code]
            last = np.append(border, k[:-1])  # before a text's first word stands the end, as after its last one
            total = lambda x: np.add.reduceat(x, at)
            rare = code[place] >= known
            cuts = np.searchsorted(place[rare], np.append(0, ends))
            others = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words.filter(pa.array(rare)))
            n = ends - at
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n - np.diff(cuts)), pa.array(total(base[code])), pa.array(total(step[last * CLASSES + k] + own[code])), others], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = src.schema["id"].dataType.simpleString()
    first = src.mapInArrow(released(run), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>")
    first = stash(first.withColumn("row", F.monotonically_increasing_id()), "op8-first")
    rare = first.select("row", F.explode("rare").alias("w"))
    c = F.col("n")
    joined = rare.join(counts, "w").groupBy("row").agg(F.sum(F.log10(c + 1.0)).alias("b"), F.sum(F.log10(c + BETA) - float(np.log10(BETA))).alias("s"), F.count("*").alias("known"))
    out = first.drop("rare").join(joined, "row", "left")
    more = lambda name, by: (F.col(name) + F.coalesce(F.col(by), F.lit(0))).alias(name)
    out = out.select(F.col("id").alias(id_col), "held_out", "n_tokens", more("n_known", "known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), more("base_score", "b"), more("score", "s"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
