"""Byte-level BPE by prefix dynamic programming (operator 5)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import released

#: Unicode's White_Space, which the tokenizer's own library takes for \s; the regex module adds \x1c-\x1f.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MEMO = 300_000
#: Rows whose ids a worker holds before it hands them on.
ROWS_AT_ONCE = 256
#: Pairs of tokens of which a worker remembers whether they may stand side by side.
FITS = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def own_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACE if inside else f"[{'^' if two == r'\S' else ''}{SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


def merge_bytes(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Byte-pair merging as defined, lowest rank first, with ranks under `below` only. For building tables and tests."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60 or below is not None and best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class PrefixEncoder:
    """Encodes byte strings by the last token of each prefix.

    Every prefix has one encoding, and of all tokens that end it just one is that encoding's last: the token t whose
    start is itself a prefix with last token s (or the beginning) such that s and t may stand side by side. So one
    pass over the bytes fills a table, whose last entries suffice to go on after an append.
    """

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves = halves if halves is not None else split_table(ranks)
        self._joined = {v: k for k, v in self.halves.items()}
        self._fits: dict[int, bool] = {}
        self._found = ahocorasick.Automaton()
        for b, i in ranks.items():
            if len(b) > 1 and i not in self.halves:
                continue  # no merge makes it: it stands for a whole piece alone
            self._found.add_word(b.decode("latin-1"), (len(b), i))
        self._found.make_automaton()

    def side_by_side(self, s: int, t: int) -> bool:
        """Whether s and t can be neighbours: no merge across their border comes before those that made them."""
        key = s << 20 | t
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > FITS:
                self._fits.clear()
            known = self._fits[key] = self._check(s, t)
        return known

    def _check(self, s: int, t: int) -> bool:
        limit, halves = 1 << 60, self.halves
        while True:
            merged = self._joined.get((s, t))
            if merged is not None and merged < limit:
                return False
            # undo whichever of the two was made later: before that, its part stood at the border
            made_s, made_t = s if s in halves else -1, t if t in halves else -1
            if made_s < 0 and made_t < 0:
                return True
            if made_s > made_t:
                limit, s = s, halves[s][1]
            else:
                limit, t = t + 1, halves[t][0]

    def extend(self, table: list[int], data: bytes, start: int = 0) -> list[int]:
        """Fill the table (last token for each prefix, entry 0 unused) for data[start:], given its first start entries."""
        fits = self.side_by_side
        table.extend([-1] * (len(data) + 1 - len(table)))
        since = max(0, start - self.longest)
        for end, (n, t) in self._found.iter(data[since:].decode("latin-1")):
            end += since + 1
            if end <= start or table[end] >= 0:
                continue
            at = end - n
            if at == 0 or at > 0 and table[at] >= 0 and fits(table[at], t):
                table[end] = t
        return table

    def read(self, table: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(table[end])
            end -= len(self.token[table[end]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.read(self.extend([-1], data), len(data))


class Piece:
    """A byte string with its prefix table: appends and edits encode again only what they touch."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.table = encoder.extend([-1], data)

    def append(self, more: bytes) -> "Piece":
        start, self.data = len(self.data), self.data + more
        self.encoder.extend(self.table, self.data, start)
        return self

    def edit(self, at: int, end: int, new: bytes) -> int:
        """Replace data[at:end]; returns how many prefixes were computed before the old table could be used again."""
        old, rest, e = self.table, self.data[end:], self.encoder
        self.data = self.data[:at] + new + rest
        table, shift, step, done = old[: at + 1], at + len(new) - end, e.longest, at
        while done < len(self.data):
            upto = min(len(self.data), max(done, at + len(new)) + step)
            e.extend(table, self.data[:upto], done)
            done = upto
            far = done - step
            # equal last tokens over the longest token's length, within unchanged bytes: all that follows is equal
            if far >= at + len(new) and done < len(self.data) and table[far : done + 1] == old[far - shift : done + 1 - shift]:
                table.extend(old[done + 1 - shift :])
                break
        self.table = table
        return done - at

    def ids(self) -> list[int]:
        return self.encoder.read(self.table, len(self.data))


def split_table(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge makes each token, for all that merging makes."""
    out = {}
    for b, i in ranks.items():
        if len(b) > 1:
            parts = merge_bytes(b, ranks, i)
            if len(parts) == 2:
                out[i] = (ranks[parts[0]], ranks[parts[1]])
    return out


class _Memo(dict):
    """Decimal ids, joined by spaces, of each piece of text; emptied when full."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        out = " ".join(map(str, self.encoder.encode(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


class TextCodec:
    def __init__(self, encoder: PrefixEncoder, pattern: str):
        self.encoder = encoder
        self.pieces = regex.compile(own_pattern(pattern)).findall
        self.memo = _Memo(encoder)
        self.bytes_of = {str(i): b for i, b in encoder.token.items()}

    def encode(self, text: str) -> str:
        memo = self.memo
        return " ".join([memo[p] for p in self.pieces(text)])

    def decode(self, ids: str) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.split(" ")]) if ids else b""


_codecs: dict[tuple[int, str], TextCodec] = {}


def _codec(shared, pattern: str) -> TextCodec:
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _codecs:
        ranks, halves = shared.value
        _codecs.clear()
        _codecs[key] = TextCodec(PrefixEncoder(ranks, halves), pattern)
    return _codecs[key]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per input row: id, the columns of `keep`, n_tokens, ids_sha256 (of the decimal ids joined by
    one space), decoded_sha256 (of the decoded bytes), and with with_ids the ids themselves. A null or empty text
    has no tokens. Each match of the pattern is encoded by itself, without special tokens. Null ids, repeated rows
    and long texts are rows like any other; other columns are ignored; an empty table gives no rows. No shuffle:
    the fixed vocabulary is broadcast, and what a worker remembers of pieces is bounded.
    """
    spark = df.sparkSession
    ranks = load_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, split_table(ranks)))

    def encoded(codec: TextCodec, b: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, back, ids = [], [], [], []
        for text in b.column(b.num_columns - 1):
            text = text.as_py()
            s = codec.encode(text) if text else ""
            n.append(s.count(" ") + 1 if s else 0)
            sha.append(hashlib.sha256(s.encode()).hexdigest())
            back.append(hashlib.sha256(codec.decode(s)).hexdigest())
            if with_ids:
                ids.append(np.fromiter(map(int, s.split(" ")) if s else (), np.int32))
        cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        names = [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for big in batches:
            for at in range(0, big.num_rows, ROWS_AT_ONCE):
                yield encoded(codec, big.slice(at, ROWS_AT_ONCE))

    first = df.select(id_col, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return df.select(id_col, *keep, F.col(text_col).alias("_text")).mapInArrow(released(run), schema)
