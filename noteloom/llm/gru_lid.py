"""Language ID by a bidirectional gated recurrent network over bytes (operator 7)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import released, slices

#: Hidden units for each direction and bytes of a window.
HIDDEN, WINDOW = 8, 64
#: The network is fitted on windows of so many labelled texts, an equal part of each language but LEAST_TEXTS of each at
#: least, those with the smallest md5 of their id, and so many windows of each.
SAMPLE_TEXTS, LEAST_TEXTS, SAMPLE_WINDOWS = 2500, 50, 8
STEPS, BATCH, RATE = 220, 128, 0.02
PAD = 0
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter becomes a space.
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letters_of(text: str) -> bytes:
    """UTF-8 of the lower-cased text, its runs of ASCII other than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split())


def windows_of(data: bytes) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteGRU:
    """h' = n + z * (h - n), n = tanh(x_n + r * g_n), z and r sigmoids of x + g, with x a row for each byte and g = h @ u.

    One such cell reads a window forwards and one backwards; each position's label distribution is a softmax of both
    states there.
    """

    def __init__(self, labels: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        k = max(1, len(labels))
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.4 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p["v" + d] = rng.normal(0, 0.3, (hidden, k)).astype(np.float32)
        self.p["c"] = np.zeros(k, np.float32)

    def _cell(self, d: str, byte: np.ndarray, state: np.ndarray, keep: bool = False):
        h = self.h
        a = np.take(self.p["x" + d], byte, axis=0)
        g = state @ self.p["u" + d]
        zr = a[:, : 2 * h]
        zr += g[:, : 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = g[:, 2 * h :] * zr[:, h:]
        n += a[:, 2 * h :]
        np.tanh(n, out=n)
        new = state - n
        new *= zr[:, :h]
        new += n
        return (new, (byte, state, zr, n, g[:, 2 * h :])) if keep else new

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """(positions, windows, labels), with one state of each direction in memory at a time."""
        b, t = windows.shape
        out = np.empty((t, b, len(self.labels)), np.float32)
        bytes_at = np.ascontiguousarray(windows.T)
        s = np.zeros((b, self.h), np.float32)
        for i in range(t):
            s = self._cell("f", bytes_at[i], s)
            np.matmul(s, self.p["vf"], out=out[i])
        s = np.zeros((b, self.h), np.float32)
        for i in range(t - 1, -1, -1):
            s = self._cell("b", bytes_at[i], s)
            out[i] += s @ self.p["vb"]
        out += self.p["c"]
        return out

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window the sum of its positions' label probabilities, and how many positions hold a letter's byte."""
        x = self.logits(windows)
        x -= x.max(axis=2, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=2, keepdims=True)
        counts = windows.T > 32
        return np.einsum("tbk,tb->bk", x, counts.astype(np.float32)), counts.sum(axis=0)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all letter positions, and its gradients by backpropagation through time."""
        b, t = windows.shape
        bytes_at = np.ascontiguousarray(windows.T)
        kept: dict[str, list] = {"f": [None] * t, "b": [None] * t}
        states: dict[str, list] = {"f": [None] * t, "b": [None] * t}
        for d in "fb":
            s = np.zeros((b, self.h), np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                s, kept[d][i] = self._cell(d, bytes_at[i], s, True)
                states[d][i] = s
        hf, hb = np.stack(states["f"]), np.stack(states["b"])
        x = hf @ self.p["vf"] + hb @ self.p["vb"] + self.p["c"]
        x -= x.max(axis=2, keepdims=True)
        e = np.exp(x)
        prob = e / e.sum(axis=2, keepdims=True)
        mask = (bytes_at > 32).astype(np.float32)
        total = max(1.0, float(mask.sum()))
        right = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (t, b, 1)), axis=2)[:, :, 0]
        loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
        dx = prob
        np.put_along_axis(dx, np.broadcast_to(y[None, :, None], (t, b, 1)), (right - 1)[:, :, None], axis=2)
        dx *= mask[:, :, None] / total
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["c"] = dx.sum(axis=(0, 1))
        h = self.h
        for d, hs in (("f", hf), ("b", hb)):
            grad["v" + d] = np.einsum("tbh,tbk->hk", hs, dx)
            back = dx @ self.p["v" + d].T
            ds, dxs = np.zeros((b, h), np.float32), np.empty((t, b, 3 * h), np.float32)
            u = self.p["u" + d]
            for i in range(t - 1, -1, -1) if d == "f" else range(t):
                ds = ds + back[i]
                _, s, zr, n, gn = kept[d][i]
                z, r = zr[:, :h], zr[:, h:]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                dxs[i, :, : 2 * h] = dg[:, : 2 * h]
                dxs[i, :, 2 * h :] = dn
                grad["u" + d] += s.T @ dg
                ds = ds * z + dg @ u.T
            flat, by = dxs.reshape(-1, 3 * h), bytes_at.reshape(-1)
            order = np.argsort(by, kind="stable")
            first = np.nonzero(np.diff(by[order], prepend=np.uint8(255 if by[order[0]] != 255 else 254)))[0]
            grad["x" + d][by[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        return loss, grad

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over batches that draw every label alike; windows and labels fix the result."""
        rng = np.random.default_rng(seed)
        of = [np.nonzero(y == k)[0] for k in range(len(self.labels))]
        of = [x for x in of if len(x)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(x, max(1, batch // len(of))) for x in of])
            loss, grad = self.gradients(windows[rows], y[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * min(1.0, step / 10) * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return losses

    def predict(self, texts: list[str | None], batch: int = 8192) -> list[tuple[str, float]]:
        """The label of each whole text and its share of the pooled probability."""
        data = [letters_of(t) if t and self.labels and _LETTER.search(t) else b"" for t in texts]
        sums, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        held, owners, rows = [], [], 0

        def settle() -> None:
            nonlocal rows
            if rows:
                x, of = np.concatenate(held), np.repeat([o for o, _ in owners], [k for _, k in owners])
                for at in range(0, len(x), batch):
                    p, c = self.pooled(x[at : at + batch])
                    np.add.at(sums, of[at : at + batch], p)
                    np.add.at(n, of[at : at + batch], c)
            held.clear()
            owners.clear()
            rows = 0

        for i, d in enumerate(data):
            if d:
                w = windows_of(d)
                held.append(w)
                owners.append((i, len(w)))
                rows += len(w)
                if rows >= batch:
                    settle()
        settle()
        out = []
        for i in range(len(texts)):
            if n[i] > 0:
                k = int(sums[i].argmax())
                out.append((self.labels[k], float(min(1.0, sums[i, k] / n[i]))))
            else:
                out.append(("und", 0.0))
        return out


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; of a null id, of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGRU:
    """Fit the network on a sample of the rows given, bounded for each language: windows spread over whole texts."""
    n = F.length("_t")
    starts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.floor(k * F.greatest(n - WINDOW, F.lit(0)) / (SAMPLE_WINDOWS - 1)).cast("int") + 1)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(id_col).cast("string").alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    found = {r["_l"]: r["count"] for r in rows.groupBy("_l").count().collect()}
    each = max(LEAST_TEXTS, SAMPLE_TEXTS // max(len(found), 1))
    cut = rows.select(F.md5(F.coalesce("_i", F.lit(""))).alias("_k"), "_l", F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("_t"), s, F.lit(WINDOW)))).alias("_w"))
    sample = []
    if found:
        # only about 4 * each rows of a language, those of its smallest keys, come to its window
        shares = F.broadcast(df.sparkSession.createDataFrame([(l, 4.0 * each / c) for l, c in found.items()], "_l string, _s double"))
        near = cut.join(shares, "_l").where(F.conv(F.substring("_k", 1, 8), 16, 10).cast("double") / 2.0**32 < F.col("_s"))
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_k", "_w"))).where(F.col("_n") <= each)
        sample = near.select("_k", "_l", "_w").collect()
        got = Counter(r["_l"] for r in sample)
        for l, c in found.items():
            if got[l] < min(each, c):  # keys that are not spread, such as null ids
                sample = [r for r in sample if r["_l"] != l] + cut.where(F.col("_l") == l).orderBy("_k", "_w").limit(each).collect()
        sample.sort(key=lambda r: (r["_k"], r["_l"], r["_w"]))
    labels = sorted({r["_l"] for r in sample})
    net = ByteGRU(labels)
    rows_w, y = [], []
    for r in sample:
        for w in r["_w"]:
            d = letters_of(w)
            if d:
                x = windows_of(d)
                rows_w.append(x[:1])
                y.append(labels.index(r["_l"]))
    if rows_w and len(labels) > 1:
        net.fit(np.concatenate(rows_w), np.array(y))
    return net


def identify(df: DataFrame, net: ByteGRU, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score added: a learned label, or und with 0 where the text is null or has no letter.

    Whole texts are read, in windows side by side; rows keep all their columns. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, at, 512):
                got = shared.value.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(released(run), f"{schema}, lang_pred string, score double")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict every row's language with a network trained on the rows whose crc32(id) mod 3 is not 1.

    Returns one row per input row: id, held_out, lang_pred, score. Only text is an input of a prediction. Null ids
    count as the empty text, repeated rows are rows like any other, other columns are ignored; with no labelled
    rows every prediction is und; an empty table gives no rows.
    """
    net = train(df.where(remainder(F.col(id_col), 3) != 1), id_col, text_col, lang_col)
    rows = df.select(F.col(id_col), F.coalesce(remainder(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    return identify(rows, net, "_text").select(id_col, "held_out", "lang_pred", "score")
