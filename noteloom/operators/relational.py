"""Cohort, deduplication, sampling, joins and metrics as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as X


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidate names that the table has, in any case."""
    by = {c.lower(): c for c in df.columns}
    return next((by[c.lower()] for c in candidates if c.lower() in by), None)


def unexpected_values(df: DataFrame, col: str, allowed: tuple[str, ...]) -> DataFrame:
    return df.select(X.clean(F.col(col)).alias("value")).where(~F.col("value").isin(*allowed)).groupBy("value").agg(F.count("*").alias("n"))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, n) after each filter on top of those before it, in one pass."""
    so_far, counts = F.lit(True), []
    for name, cond in steps:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    one = df.agg(F.count("*").alias("all"), *counts)
    names = ["all", *[n for n, _ in steps]]
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in names])).alias("step", "x")).select("step", "x.name", "x.n")


def cap_per_key(df: DataFrame, key: str, row_id: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each key, drawn by a hash that reruns repeat."""
    h = F.sha1(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(h, F.col(row_id)))).where(F.col("_r") <= n).drop("_r")


def quotas(counts: dict[str, int], n: int) -> dict[str, int]:
    """Proportional whole quotas of n over strata, each at least 1; what is missing goes to, what is over comes from, the largest."""
    if not counts:
        return {}
    if len(counts) > n:
        raise ValueError("more strata than rows to sample")
    total = sum(counts.values())
    if n >= total:
        return dict(counts)
    out = {k: max(1, int(n * c / total)) for k, c in counts.items()}
    while sum(out.values()) > n:
        out[max((k for k in out if out[k] > 1), key=lambda k: (out[k], k is not None, k))] -= 1
    spare = sorted(counts, key=lambda k: (-counts[k], k is not None, k))
    while sum(out.values()) < n:
        k = next(k for k in spare if out[k] < counts[k])
        out[k] += 1
    return out


def stratified_sample(df: DataFrame, stratum: str, row_id: str, n: int, seed: str) -> DataFrame:
    """n rows in proportion to the strata, null being one; the quotas come from one count per stratum, of which there are n at most."""
    counts = df.groupBy(stratum).count().limit(n + 1).collect()
    got = quotas({r[0]: r[1] for r in counts}, n)
    q = df.sparkSession.createDataFrame(list(got.items()), f"_stratum {df.schema[stratum].dataType.simpleString()}, quota long")
    h = F.sha1(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(h, F.col(row_id))))
    return ranked.join(F.broadcast(q), F.col(stratum).eqNullSafe(F.col("_stratum"))).where("_r <= quota").drop("_r", "_stratum", "quota")


def alias_map(aliases: DataFrame) -> DataFrame:
    """(alias, canonical): included rows only, the last one of an alias."""
    a = aliases.where("include").select(X.drug_norm(F.col("alias_raw")).alias("alias"), F.col("canonical"), "ord").where("alias <> ''")
    return a.groupBy("alias").agg(F.max_by("canonical", "ord").alias("canonical"))


def synonym_map(vocab: DataFrame) -> DataFrame:
    """(synonym, label): each label is a synonym of itself; the first label in order wins."""
    s = vocab.select(F.explode(F.concat(F.array("canonical"), "synonyms")).alias("s"), F.col("canonical").alias("label"))
    return s.select(X.drug_norm(F.col("s")).alias("synonym"), "label").where("synonym <> ''").groupBy("synonym").agg(F.min("label").alias("label"))


def left_join_nonblank(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a text key that null and blank keys, often many, do not take part in: they would all meet in one task."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    met = rows.where(~blank).join(right, key, "left")
    return met.unionByName(rows.where(blank).select("*", *more))


def normalization_ladder(mentions: DataFrame, aliases: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each mention's surface form, lexical form, alias result and safe decomposition.

    Alias and synonym tables are joined by plain equi-joins: Spark broadcasts what its threshold allows.
    """
    am, sm = alias_map(aliases), synonym_map(vocab)
    m = mentions.withColumn("a1", X.surface(F.col("raw"))).withColumn("a2", X.drug_norm(F.col("raw")))
    m = left_join_nonblank(m, am.withColumnRenamed("alias", "a2"), "a2").withColumn("a3", F.coalesce("canonical", "a2")).drop("canonical")
    m = left_join_nonblank(m, sm.withColumnRenamed("synonym", "a3"), "a3").withColumn("vocab_label", F.coalesce("label", F.lit(""))).drop("label")
    term = X.drug_norm(F.col("a3"))
    parts = F.filter(F.transform(F.split(term, r"(?U)\s*(?:/|\+|plus|and|with)\s*"), X.strip), lambda p: p != "")
    m = m.withColumn("term", term).withColumn("parts", F.when(term.rlike("/| \\+ | plus | and | with "), parts).otherwise(F.array().cast("array<string>")))
    split = m.where(F.size("parts") >= 2).select("mention_id", F.explode("parts").alias("p")).select("mention_id", X.drug_norm(F.col("p")).alias("synonym")).where("synonym <> ''").join(sm, "synonym", "left")
    solved = split.groupBy("mention_id").agg(F.countDistinct("label").alias("k"), F.count_if(F.col("label").isNull()).alias("open"), F.min("label").alias("one")).where("k = 1 and open = 0")
    m = m.join(solved.select("mention_id", "one"), "mention_id", "left")
    return m.withColumn("a4", F.coalesce("one", "term")).select("mention_id", "raw", "gold", "a1", "a2", "a3", "a4", "vocab_label")


def outer_alignment(truth: DataFrame, seeds: DataFrame) -> DataFrame:
    """Reviewed mentions against extracted ones by unit id, then note, span and mention, then note and mention.

    Of seeds with one unit id the last wins, of those with one span or note key the first, which is flagged. Seeds
    that no truth row took are false positives.
    """
    norm = lambda c: X.collapse(X.clean(F.col(c)))
    s = seeds.withColumn("norm", norm("raw"))
    t = truth.withColumn("norm", norm("raw"))
    unit = s.where("unit_id <> ''").groupBy("unit_id").agg(F.max("ord").alias("o1"))
    span = s.groupBy("note_id", "span_id", "norm").agg(F.min("ord").alias("o2"), F.count("*").alias("n2"))
    note = s.groupBy("note_id", "norm").agg(F.min("ord").alias("o3"), F.count("*").alias("n3"))
    j = left_join_nonblank(t, unit, "unit_id").join(span, ["note_id", "span_id", "norm"], "left").join(note, ["note_id", "norm"], "left")
    method = (
        F.when(F.col("o1").isNotNull(), "adjudication_unit_id")
        .when(F.col("n2") == 1, "note_span_mention").when(F.col("n2") > 1, "note_span_mention_multi")
        .when(F.col("n3") == 1, "note_mention").when(F.col("n3") > 1, "note_mention_multi")
        .otherwise("unmatched_truth_row")
    )
    j = j.withColumn("seed_ord", F.coalesce("o1", "o2", "o3")).withColumn("join_method", method)
    flag = F.when(F.col("join_method") == "note_span_mention_multi", "multiple_seed_candidates_same_span_mention").when(F.col("join_method") == "note_mention_multi", "multiple_seed_candidates_same_note_mention").otherwise("")
    rows = j.select(F.when(F.col("seed_ord").isNotNull(), "matched").otherwise("false_negative").alias("alignment_status"), "join_method", flag.alias("audit_flag"), "truth_id", "seed_ord", "note_id")
    free = s.join(rows.where("seed_ord is not null").select(F.col("seed_ord").alias("ord")).distinct(), "ord", "left_anti")
    fp = free.select(F.lit("false_positive").alias("alignment_status"), F.lit("unmatched_seed_row").alias("join_method"), F.lit("needs_manual_review_if_true_mention_missed_in_adjudication").alias("audit_flag"), F.lit(None).cast("long").alias("truth_id"), F.col("ord").alias("seed_ord"), "note_id")
    return rows.unionByName(fp)


def prf(df: DataFrame, *keys: str) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 from alignment rows, overall or for each value of the keys."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.col("alignment_status") == s).alias(n) for n, s in (("tp", "matched"), ("fp", "false_positive"), ("fn", "false_negative"))])
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    g = g.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def slices(aligned: DataFrame, dimensions: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Metrics of alignment rows for each value of each dimension, whose table has the key once; unknown where a row has none."""
    own = aligned.join(dimensions.select(key, *names), key, "left")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(n), F.lit("unknown")).alias("slice")) for n in names]))
    return prf(own.select("alignment_status", each.alias("x")).select("alignment_status", "x.*"), "dimension", "slice")


def apply_patch(rows: DataFrame, decisions: DataFrame, fields: list[str]) -> DataFrame:
    """Review decisions by unit id: drop_row deletes, the others overwrite the given fields; the last decision counts."""
    last = decisions.groupBy("unit_id").agg(F.max_by(F.struct("review_action", *[F.col(f) for f in fields]), "ord").alias("d"), F.max(F.when(F.col("review_action") == "drop_row", True).otherwise(False)).alias("dropped"))
    j = rows.join(last, "unit_id", "left").where(~F.coalesce("dropped", F.lit(False)))
    hit = F.col("d").isNotNull()
    return j.select("unit_id", *[F.when(hit, F.col(f"d.{f}")).otherwise(F.col(f)).alias(f) for f in fields], F.coalesce(F.col("d.review_action") == "needs_manual_followup", F.lit(False)).alias("followup"))


def visit_ranks(visits: DataFrame, person: str, visit: str, date: str) -> DataFrame:
    return visits.withColumn("rank", F.row_number().over(Window.partitionBy(person).orderBy(date, visit)) - 1)


def windowed_union(ranked: DataFrame, person: str, terms: str, k: int) -> DataFrame:
    """Each visit's sorted distinct terms over the visits up to k ranks before and after."""
    w = Window.partitionBy(person).orderBy("rank").rangeBetween(-k, k)
    return ranked.withColumn(terms, F.array_sort(F.array_distinct(F.flatten(F.collect_list(terms).over(w)))))


def concordance(pairs: DataFrame) -> DataFrame:
    """note and other term lists of each visit to overlap measures."""
    n, o = F.col("note_terms"), F.col("ehr_terms")
    return pairs.select(
        "person_id", "visit_id", X.jaccard(n, o).alias("jaccard"), X.containment(n, o).alias("containment"), X.relaxed_containment(n, o).alias("containment_relaxed"),
        F.size(n).cast("long").alias("note_n"), F.size(o).cast("long").alias("ehr_n"), (F.size(F.array_intersect(n, o)) > 0).cast("int").alias("has_overlap"), X.relaxed_overlap(n, o).alias("has_overlap_relaxed"),
    )


def char_grams(c: Column) -> Column:
    """Character 3- and 4-grams of the text with a space at either end."""
    p = F.concat(F.lit(" "), c, F.lit(" "))
    grams = lambda n: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(grams(3), grams(4))


def tfidf_scores(mentions: DataFrame, concepts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, mention, label, score): positive TF-IDF cosines over character grams of distinct mentions and concepts.

    idf = ln((1 + N) / (1 + df)) + 1 over the concepts, 1 for grams they lack. Only pairs with a common gram meet. With
    `by` each group is fitted and scored by itself.
    """
    n = concepts.groupBy(*by).agg(F.count("*").alias("total"))
    grams = lambda t, c, tf: t.select(*by, c, F.explode(char_grams(F.col(c))).alias("gram")).groupBy(*by, c, "gram").agg(F.count("*").alias(tf))
    cg = grams(concepts, "label", "tf")
    df = cg.groupBy(*by, "gram").agg(F.count("*").alias("df"))
    df = df.join(n, [*by]) if by else df.crossJoin(F.broadcast(n))
    idf = df.select(*by, "gram", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    cw = cg.join(idf, [*by, "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
    cn = cw.groupBy(*by, "label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cn"))
    mg = grams(mentions.select(*by, "mention").distinct(), "mention", "mtf")
    mw = mg.join(idf, [*by, "gram"], "left").withColumn("mw", F.col("mtf") * F.coalesce("idf", F.lit(1.0)))
    mn = mw.groupBy(*by, "mention").agg(F.sqrt(F.sum(F.col("mw") * F.col("mw"))).alias("mn"))
    dots = mw.join(cw.select(*by, "label", "gram", "w"), [*by, "gram"]).groupBy(*by, "mention", "label").agg(F.sum(F.col("mw") * F.col("w")).alias("dot"))
    return dots.join(cn, [*by, "label"]).join(mn, [*by, "mention"]).select(*by, "mention", "label", (F.col("dot") / (F.col("mn") * F.col("cn"))).alias("score")).where("score > 0")


def tfidf_best(mentions: DataFrame, concepts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The concept of largest score for each mention; ties to the smaller label."""
    best = tfidf_scores(mentions, concepts, by).groupBy(*by, "mention").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "label")).alias("b"))
    return best.select(*by, "mention", "b.label", (-F.col("b.s")).alias("score"))


def key_codes(keys, last: list) -> tuple[list[int], bool, list]:
    """Codes of an Arrow column of sorted keys, whether its first key is the one in `last`, and its last key as the next `last`; nulls are one key, NaNs another."""
    first = keys[0].as_py()
    goes_on = bool(last) and (last[0] == first or last[0] != last[0] and first != first)
    return keys.dictionary_encode(null_encoding="encode").indices.to_numpy().tolist(), goes_on, [keys[-1].as_py()]
