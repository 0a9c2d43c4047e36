"""Near-duplicate embeddings by Int8 tile products with rigorous error bounds (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import join_one, stash
from noteloom.llm.graph import components

BLOCK_ROWS = 4096
PIVOTS = 32
#: Up to so many blocks, tiles that cannot hold a link are left out before the shuffle; beyond, each task finds that out.
PLANNED_BLOCKS = 2048
#: So many vectors at most that more than 1000 rows share are broadcast with their class.
HOT_VECTORS = 5000
SLACK = 1e-5  # for float32 scaling, far above its rounding


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of x as Int8 codes, the scale of each, and the length of what the codes leave out."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, lost * (1 + 1e-9) + 1e-12


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of codes: float32 holds the sums of 1024 Int8 products exactly."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024] @ b[:, k : k + 1024].T
        out = part if out is None else out.astype(np.float64) + part
    return out


def tile_links(xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of xa and xb whose cosine reaches the threshold, a strip of rows at a time.

    With u = s*q + e, |u.v - s_u*s_v*(q_u.q_v)| <= e_u*(1 + e_v) + e_v: only pairs whose bounds hold the
    threshold are computed again, in double precision from the stored vectors.
    """
    qa, sa, ea = quantise(xa)
    qb, sb, eb = (qa, sa, ea) if same else quantise(xb)
    na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    fb, scale_b = qb.astype(np.float32), sb.astype(np.float32)
    reach = ea.max() * (1 + eb.max()) + eb.max() + SLACK
    for at in range(0, len(xa), 512):
        rows = slice(at, at + 512)
        p = int_products(qa[rows].astype(np.float32), fb)
        p = p * sa[rows, None].astype(p.dtype)
        p *= scale_b
        i, j = np.nonzero(p >= threshold - reach)
        got, i = p[i, j].astype(np.float64), i + at
        if same:
            keep = i != j
            i, j, got = i[keep], j[keep], got[keep]
        bound = ea[i] * (1 + eb[j]) + eb[j] + SLACK
        sure = got - bound >= threshold
        open_ = np.nonzero(~sure & (got + bound >= threshold))[0]
        for k in range(0, len(open_), 50_000):
            o = open_[k : k + 50_000]
            cos = np.einsum("ij,ij->i", xa[i[o]], xb[j[o]]) / (na[i[o]] * nb[j[o]])
            sure[o[cos >= threshold]] = True
        if sure.any():
            yield i[sure], j[sure]


def _tile(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a = frame.iloc[int(frame["block"].to_numpy().argmin())]
        b = frame.iloc[int(frame["block"].to_numpy().argmax())]
        same = a["block"] == b["block"]
        none = pd.DataFrame({"node": np.array([], "i8"), "links": np.array([], "i8"), "root": np.array([], "i8")})
        if a["dim"] != b["dim"]:
            return none
        load = lambda r: np.frombuffer(r["vecs"], np.float32).reshape(-1, r["dim"]).astype(np.float64)
        if not same and not _near(np.frombuffer(a["centre"], "f8"), a["radius"], np.frombuffer(b["centre"], "f8"), b["radius"], threshold):
            return none
        ia, ib = np.frombuffer(a["ids"], "i8"), np.frombuffer(b["ids"], "i8")
        ca, cb = np.frombuffer(a["copies"], "i8"), np.frombuffer(b["copies"], "i8")
        xa = load(a)
        xb = xa if same else load(b)
        off = 0 if same else len(xa)
        label, links = np.arange(off + len(xb)), np.zeros(off + len(xb), np.int64)
        for i, j in tile_links(xa, xb, threshold, same):
            np.add.at(links, i, cb[j])
            if not same:
                np.add.at(links, j + off, ca[i])
            cuts = np.nonzero(np.diff(i, prepend=-1))[0]
            for lo, hi in zip(cuts, [*cuts[1:], len(i)]):
                has = label[np.append(j[lo:hi] + off, i[lo])]
                least = has.min()
                if (has != least).any():
                    label[np.isin(label, np.unique(has))] = least
        ids = ia if same else np.concatenate([ia, ib])
        hit = np.nonzero(links)[0]
        return pd.DataFrame({"node": ids[hit], "links": links[hit], "root": ids[label[hit]]})

    return run


def _near(ca, ra, cb, rb, threshold: float) -> bool:
    """Whether two caps on the sphere can hold a pair within the threshold's angle."""
    return float(np.arccos(np.clip(ca @ cb, -1, 1))) - ra - rb <= np.arccos(threshold) + 1e-6


def _blocks(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(frame["vec"].to_list()).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else np.eye(1, x.shape[1])[0]
    radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-6
    return pd.DataFrame([{"block": int(key[0]), "dim": x.shape[1], "ids": frame["node"].to_numpy("i8").tobytes(), "copies": frame["n"].to_numpy("i8").tobytes(), "vecs": x.tobytes(), "centre": centre.tobytes(), "radius": radius}])


def _cells(pivots: dict[int, np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.zeros(len(f), np.int32)
            dims = f["dim"].to_numpy()
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                if d in pivots:
                    cell[at] = np.argmax(np.stack(f["vec"].iloc[at].to_list()).astype(np.float32) @ pivots[d].T, axis=1)
            yield f.assign(cell=cell)

    return run


def near_links(df: DataFrame, id_col: str, vec_col: str, threshold: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links between all vectors whose cosine in double precision reaches the threshold.

    Returns one row per input row: id, n_links (other rows linked directly), component_id (smallest id reached,
    itself included), kept (id = component_id). Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, as do vectors of different lengths with each other. A row with a null id links
    with nothing: n_links 0, component_id null, kept false. Rows that repeat a vector count as vectors of their
    own; rows that share an id count as one node. Other columns are ignored; an empty table gives no rows.

    Equal vectors are grouped first. The groups are packed by nearest pivot into blocks of about block_rows rows;
    each pair of blocks whose caps on the sphere come near enough is one tile, computed in a task of its own,
    which returns at most a count and a spanning edge for each row, however many pairs are linked.
    """
    rows = df.select(F.col(id_col).cast("long").alias("node"), F.col(vec_col).cast("array<float>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fit = F.col("node").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & (norm > 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    groups = rows.where("fit").groupBy("vec").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    of = stash(groups.select(F.col("first").alias("node"), "n", "vec", F.size("vec").alias("dim")), "op1-groups")
    picks = of.orderBy(F.xxhash64("node"), "node").limit(PIVOTS).select("dim", "vec").collect()
    pivots: dict[int, np.ndarray] = {}
    for d in {r["dim"] for r in picks}:
        x = np.array([r["vec"] for r in picks if r["dim"] == d], np.float64)
        pivots[d] = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    total = of.count()
    subs = max(64, int(total / block_rows * 8 / PIVOTS) + 1)
    celled = of.mapInPandas(_cells(pivots), "node long, n long, vec array<float>, dim int, cell int").withColumn("sub", F.pmod(F.xxhash64("node"), F.lit(subs)).cast("int"))
    celled = stash(celled, "op1-cells")
    counts = celled.groupBy("dim", "cell", "sub").count().orderBy("dim", "cell", "sub")
    plan, block, filled, dim = [], -1, 0, None  # of a few hundredths of a row for each row of the input
    for r in counts.toLocalIterator():
        if r["dim"] != dim or filled + r["count"] > block_rows * 1.1 or filled >= block_rows:
            block, filled, dim = block + 1, 0, r["dim"]
        filled += r["count"]
        plan.append((r["dim"], r["cell"], r["sub"], block))
    spark = df.sparkSession
    if block < 0:
        found = spark.createDataFrame([], "node long, links long, root long")
    else:
        placed = celled.join(spark.createDataFrame(plan, "dim int, cell int, sub int, block int"), ["dim", "cell", "sub"])
        blocks = stash(placed.groupBy("block").applyInPandas(_blocks, "block int, dim int, ids binary, copies binary, vecs binary, centre binary, radius double"), "op1-blocks")
        n = block + 1
        if n <= PLANNED_BLOCKS:
            caps = [(r["block"], np.frombuffer(r["centre"], "f8"), r["radius"], r["dim"]) for r in blocks.select("block", "centre", "radius", "dim").toLocalIterator()]
            caps.sort(key=lambda c: c[0])
            partners = [(c[0], [o[0] for o in caps if o[3] == c[3] and (o[0] == c[0] or _near(c[1], c[2], o[1], o[2], threshold))]) for c in caps]
            tiles = blocks.join(spark.createDataFrame(partners, "block int, other array<int>"), "block").withColumn("other", F.explode("other"))
        else:
            tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        tiles = tiles.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        found = tiles.groupBy("lo", "hi").applyInPandas(_tile(threshold), "node long, links long, root long")
    found = stash(found, "op1-found")
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = of.groupBy("node", "vec").agg(F.max("n").alias("n")).join(links, "node", "left").join(comp, "node", "left")
    group = group.select("vec", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    # copies of a common vector meet its group by a broadcast
    group = stash(group, "op1-classes")
    out = join_one(rows.where("fit").select("node", "vec"), group, "vec", "n", keys=HOT_VECTORS).select("node", "links", "component")
    none = rows.where("not fit").select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("component"))
    out = out.unionByName(none).select(F.col("node").alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
