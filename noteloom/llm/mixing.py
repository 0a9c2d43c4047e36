"""Mixing sources to target weights, in DataFrame operations only (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import discard, join_one, stash

WEIGHTS = (5, 2, 1)
CAP = 3
#: So many sources, the largest, are broadcast; rows of any others meet theirs by a join.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n, source_size) with each source's target: shares of the total by weight, none above cap times its size.

    Sources come in code point order, null last, and take the weights in turn. Resharing what lies above a cap by
    weight until none is above ends where target = min(cap, weight * level); in order of cap over weight the capped
    sources come first, so prefix sums over the sources find the level.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("before", F.sum("cap").over(upto) - F.col("cap"))
    s = s.withColumn("after", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("cap") <= F.col("w") * ((F.col("total") - F.col("before")).cast("double") / F.col("after")))
    every = Window.partitionBy()
    s = s.withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    s = s.withColumn("open_w", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("rest").cast("double") / F.col("open_w")))
    return s.withColumn("target", target).select("source", "n", "source_size", "target")


def row_key(id_: Column, text: Column) -> Column:
    """A hash-random key: md5 of the id and of the text, so that rows without an id, or that share one, are spread too."""
    return F.md5(F.concat_ws(" ", F.coalesce(id_.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def times(n: Column, step: int = 10_000) -> tuple[Column, Column]:
    """Two columns to be exploded one after the other, `_c` and then the second one, that give n rows from short arrays."""
    return F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step)), F.sequence(F.col("_c") * step, F.least(n, (F.col("_c") + 1) * step) - 1)


def _shares(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(id, source, key, size, k, source_size, target, epochs, start, budget) of distinct rows, k being how many rows are
    equal and start the source's words before them in the order of keys; and what was stored for it."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), row_key(F.col(id_col), F.col(text_col)).alias("key"), word_count(F.col(text_col)).alias("size"))
    sizes = rows = stash(rows.groupBy("id", "source", "key", "size").agg(F.count("*").alias("k")), "op9-sizes")
    sources = stash(source_targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("k")).alias("source_size")), weights, cap), "op9-sources")
    right = sources.withColumn("src", src_of(F.col("source"))).drop("source")
    rows = join_one(rows.withColumn("src", src_of(F.col("source"))), right.withColumn("_n", F.col("n")), "src", "_n", keys=BROADCAST_SOURCES, hot=0)
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = rows.withColumn("part", F.floor(at * F.ceil(F.sqrt(F.col("n").cast("double")))))
    words = F.col("size") * F.col("k")
    starts = rows.groupBy("src", "part").agg(F.sum(words).alias("sum"))
    run = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = starts.withColumn("before", F.sum("sum").over(run) - F.col("sum")).drop("sum")
    within = Window.partitionBy("src", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum(words).over(within) - words).join(starts, ["src", "part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    return rows.withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "part"), (sizes, sources)


def src_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """How many words the mix takes from each document.

    Returns one row per input row: id, source, size (words of the text, null: 0), source_size, target (its
    source's), taken. A source of size S and target T gives floor(T / S) whole epochs; for the rest its documents
    come in the order of their keys (md5 of id and text) and are cut at the exact budget: the document in which it
    ends gives its first words up to there. So a source's words are its target without the fraction, and no document
    exceeds cap times its size. Reruns agree. Null ids and repeated rows are rows like any other; a null source is a
    source of its own, the last; a source without words has target 0; an empty table gives no rows. Other columns are
    ignored.

    Equal rows are counted first, and go through as one. Keys are uniform, so equal key ranges of a source are even:
    sqrt(n) ranges for n documents, sorted by themselves; their totals, summed over the ranges of a source, are where
    each range starts.
    """
    rows, _ = _shares(df, id_col, text_col, source_col, weights, cap)
    chunks, copies = times(F.col("k"))
    rows = rows.withColumn("_c", F.explode(chunks)).withColumn("_j", F.explode(copies))
    rest = F.floor(F.col("budget")).cast("long") - F.col("start") - F.col("_j") * F.col("size")
    more = F.when(F.col("epochs") < cap, F.greatest(F.least(rest, F.col("size")), F.lit(0).cast("long"))).otherwise(0)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of df with all their columns, each as often as the mix takes it: not at all to cap times.

    Documents stay whole here: the one in which a source's budget ends is taken once more if its middle lies within
    it. Rows without words are taken with whole epochs only. Equal rows at the cut are told apart by where they are
    read. Nulls and repeats as in `mix`; an empty table gives no rows.

    One key for each source, its cut, decides every row where it is read, so texts are not shuffled: sources up to
    BROADCAST_SOURCES, the largest, are broadcast; only rows of sources beyond meet theirs by a join.
    """
    rows, stored = _shares(df, id_col, text_col, source_col, weights, cap)
    whole = F.when(F.col("size") > 0, F.floor((F.col("budget") - F.col("start")) / F.col("size") + 0.5)).otherwise(0)
    rows = rows.withColumn("m", F.least(F.greatest(whole, F.lit(0)), F.col("k")).cast("long"))
    last = F.max(F.when((F.col("epochs") < cap) & (F.col("m") > 0), F.struct("key", "m", "k"))).alias("last")
    cuts = stash(rows.groupBy("src").agg(F.count("*").alias("_n"), F.first("epochs").cast("int").alias("_epochs"), last).select("src", "_n", "_epochs", F.col("last.key").alias("_cut"), F.col("last.m").alias("_m"), F.col("last.k").alias("_k")), "op9-cuts")
    discard(*stored)
    own = df.select(F.struct(*df.columns).alias("_row"), src_of(F.col(source_col)).alias("src"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), (F.length(F.trim(F.coalesce(F.regexp_replace(F.col(text_col), r"[\x09-\x0D]", " "), F.lit("")))) > 0).alias("_full"))
    own = join_one(own, cuts, "src", "_n", keys=BROADCAST_SOURCES, hot=0)
    more = F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))
    if cuts.where("_m < _k").limit(1).count():  # equal rows at a cut: the first _m as they lie in their files
        tied = F.coalesce((F.col("_key") == F.col("_cut")) & (F.col("_m") < F.col("_k")), F.lit(False))
        ties = stash(own.where(tied).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "op9-ties")
        parts = ties.groupBy("src", "_p").agg(F.count("*").alias("_c"))
        parts = parts.withColumn("_from", F.sum("_c").over(Window.partitionBy("src").orderBy("_p")) - F.col("_c")).drop("_c")
        ties = ties.withColumn("_at", F.row_number().over(Window.partitionBy("src", "_p").orderBy("_i"))).join(parts, ["src", "_p"])
        ties = ties.withColumn("_more", F.col("_from") + F.col("_at") <= F.col("_m"))
        own = own.where(~tied).withColumn("_more", more).select("_row", "_epochs", "_full", "_more").unionByName(ties.select("_row", "_epochs", "_full", "_more"))
    else:
        own = own.withColumn("_more", more)
    taken = F.col("_epochs") + (F.col("_full") & F.col("_more")).cast("int")
    return own.withColumn("_t", F.explode(F.sequence(F.lit(0), taken))).where("_t > 0").select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
p AS (SELECT *, (sum(cap) OVER o - cap)::BIGINT AS before, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap <= w * ((total - before)::DOUBLE / after) AS capped FROM p),
l AS (SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE AS rest, sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE w END) OVER () AS open_w FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w * (rest / open_w) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + CASE WHEN epochs < 3 THEN greatest(least(floor(target - epochs * source_size)::BIGINT - start, size), 0) ELSE 0 END)::BIGINT AS taken FROM r
"""
