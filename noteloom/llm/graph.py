"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import discard, join_one, stash

CHUNK = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each chunk of edges by the stars of its components, which link the same nodes."""

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        held.clear()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
        for i, x in enumerate(up):  # a parent never comes after its child
            up[i] = up[x]
        root = np.asarray(up, dtype=np.int64)
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield stars()
            rows = 0
    if rows:
        yield stars()


def _lowest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, v, m) for each edge: m is the smallest neighbour of u, or u itself; a stored table behind it). Edges of hubs
    are not shuffled."""
    low = stash(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-low")
    return join_one(edges, low, "u", "n").select("u", "v", F.least("u", "m").alias("m")), low


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs to (node, component): for every node of an edge the smallest node it reaches.

    Nulls and loops link nothing; repeated edges count once; no edges give no rows. Nothing is gathered on the
    driver but counts, a checksum for each round and the hottest nodes (at most HOT_KEYS), whose edges meet them by a
    broadcast; all others are combined before the shuffle and joined by it.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    e = stash(e.mapInArrow(_contract, "u long, v long").distinct(), "cc", rows=CHUNK)
    seen = None
    while True:
        met, low = _lowest(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = stash(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        discard(low)
        met, low = _lowest(large)
        small = met.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        old, e = e, stash(small.select("x.u", "x.v").where("u <> v").distinct(), "cc")
        discard(low, large, old)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(hash(u, v), 65536) as long))")).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
