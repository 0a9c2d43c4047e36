"""Scored linking of mentions to a canonical vocabulary, and greedy assignment of reviewed terms to extracted ones."""

from __future__ import annotations

from collections import deque
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from noteloom.functions import text as X
from noteloom.operators import relational as R

# Weights, thresholds and statuses that right results need.
WEIGHTS = {"exact_norm_eq": 0.28, "exact_token_set_eq": 0.10, "token_jaccard": 0.14, "containment_ratio": 0.14, "edit_similarity": 0.10, "longest_token_overlap": 0.06, "first_informative_token_match": 0.05, "alias_hit": 0.05, "brand_generic_relation": 0.03, "ingredient_overlap": 0.03, "abbreviation_expansion_hit": 0.02}
TOP_K, MIN_SCORE, MIN_MARGIN, MIN_LENGTH, MIN_SCORE_SHORT, MIN_CONFIDENCE = 20, 0.45, 0.05, 4, 0.80, 0.90
OUT_OF_SCOPE = ("unclear", "reference_only", "reference_only_or_discussion_only", "planned_or_considering", "historical_prior", "planned_considering", "discussion_only")
FALLBACK_LABELS = ("paclitaxel", "docetaxel", "pembrolizumab", "nivolumab")
# End of the fixed values.

MEMO = 100_000  # points that a worker remembers


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: (t != "") & ~t.isin(*X.NOISE_TOKENS)))


def ingredients(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(norm, r"\b(?:and|with|plus)\b", " "), " +"), lambda t: F.length(t) >= 3))


def universe(aliases: DataFrame, vocab: DataFrame) -> DataFrame:
    """(label, synonyms, aliases, ingredients, combo): normalized labels of the alias map and the vocabulary."""
    norm = lambda c: X.drug_norm(F.col(c))
    a = R.alias_map(aliases).select(norm("canonical").alias("label"), norm("alias").alias("s"), F.lit(True).alias("is_alias"))
    v = vocab.select(norm("canonical").alias("label"), F.explode_outer("synonyms").alias("s")).select("label", X.drug_norm(F.col("s")).alias("s"), F.lit(False).alias("is_alias"))
    rows = a.unionByName(v).where("label <> ''")
    fallback = aliases.sparkSession.createDataFrame([(x, x, False) for x in FALLBACK_LABELS], "label string, s string, is_alias boolean")
    some = rows.select(F.lit(1).alias("one")).limit(1)
    rows = rows.unionByName(fallback.join(F.broadcast(some), F.lit(True), "left_anti"))
    syn = F.array_sort(F.array_union(F.collect_set(F.when(F.col("s") != "", F.col("s"))), F.array("label")))
    u = rows.groupBy("label").agg(syn.alias("synonyms"), F.array_sort(F.collect_set(F.when(F.col("is_alias") & (F.col("s") != ""), F.col("s")))).alias("aliases"))
    u = u.withColumn("ingredients", ingredients(F.col("label")))
    return u.withColumn("combo", F.col("label").rlike(r"\b(?:and|with|plus)\b") | (F.size(F.split("label", " ")) >= 4) & (F.size("ingredients") >= 2))


def char_neighbours(mentions: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(mention, label): the n labels of largest TF-IDF cosine, filled up with the first labels in order."""
    near = R.tfidf_scores(mentions, labels)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("mention").orderBy(F.round("score", 9).desc(), "label"))).where(F.col("_r") <= n).select("mention", "label")
    first = labels.select("label").orderBy("label").limit(n).agg(F.array_sort(F.collect_list("label")).alias("first"))  # n labels at most
    have = near.groupBy("mention").agg(F.collect_set("label").alias("have"))
    pad = mentions.select("mention").distinct().join(have, "mention", "left").crossJoin(F.broadcast(first))
    have_or_none = F.coalesce("have", F.array().cast("array<string>"))
    more = F.slice(F.array_except("first", have_or_none), F.lit(1), F.greatest(F.lit(n) - F.size(have_or_none), F.lit(0)))
    return near.unionByName(pad.select("mention", F.explode(more).alias("label")))


def candidates(mentions: DataFrame, uni: DataFrame, abbreviations: DataFrame, k: int = TOP_K) -> DataFrame:
    """(mention, label, edit): the k labels that rank first by 0.65 word Jaccard and 0.35 edit similarity.

    Labels come from a word in common with one of their synonyms, from an abbreviation's expansion and from character
    grams; all are equi-joins on distinct mentions. Equal ranks go by label.
    """
    syn = uni.select("label", F.explode("synonyms").alias("s"))
    words = syn.select("label", F.explode(F.split("s", " ")).alias("w")).where("length(w) >= 2").distinct()
    m = mentions.select("mention").distinct()
    by_word = m.select("mention", F.explode(_words(F.col("mention"))).alias("w")).join(words, "w").select("mention", "label")
    first = syn.groupBy("s").agg(F.min("label").alias("label"))
    by_abbr = m.join(abbreviations, m["mention"] == abbreviations["abbr"]).select("mention", F.col("expanded").alias("s")).join(first, "s").select("mention", "label")
    exact = m.select("mention", F.col("mention").alias("s")).join(first, "s").select("mention", "label")
    pairs = by_word.unionByName(by_abbr).unionByName(exact).unionByName(char_neighbours(m, uni, max(2 * k, 20))).distinct()
    pairs = pairs.withColumn("edit", seq_ratio("mention", "label"))
    rank = 0.65 * X.jaccard(_words(F.col("mention")), _words(F.col("label"))) + 0.35 * F.col("edit")
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("mention").orderBy(rank.desc(), "label"))).where(F.col("_r") <= k).drop("_r")


def features(m: Column, expanded: Column, edit: Column) -> dict[str, Column]:
    """The twelve features of a mention against the universe's row beside it."""
    a, b = _words(m), _words(F.col("label"))
    both = F.array_intersect(a, b)
    num = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    longest = lambda x: F.array_max(F.transform(x, F.length))
    ordered = lambda c: F.try_element_at(F.filter(F.split(c, " "), lambda t: (t != "") & ~t.isin(*X.NOISE_TOKENS)), F.lit(1))
    alias = F.array_contains("aliases", m)
    return {
        "exact_norm_eq": num((m == F.col("label")) | F.array_contains("synonyms", m)),
        "exact_token_set_eq": num((F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.size(both) == F.size(a))),
        "token_jaccard": X.jaccard(a, b),
        "containment_ratio": F.size(both) / F.greatest(F.size(a), F.lit(1)),
        "edit_similarity": edit,
        "longest_token_overlap": F.coalesce(longest(both) / longest(a), F.lit(0.0)),
        "first_informative_token_match": num(ordered(m) == ordered(F.col("label"))),
        "alias_hit": num(alias),
        "brand_generic_relation": num(alias & (m != F.col("label"))),
        "ingredient_overlap": num(F.size(F.array_intersect(both, F.col("ingredients"))) > 0),
        "combo_partial_overlap_flag": num(F.col("combo") & (F.size(both) > 0) & (F.size(both) < F.greatest(F.size(b), F.lit(1)))),
        "abbreviation_expansion_hit": num(F.array_contains("synonyms", expanded)),
    }


def calibrated(score: Column, calibration: dict | None) -> Column:
    """identity, platt {a, b} or score_bins {bins: [score_min, score_max, precision]}, the first bin that holds the score."""
    kind = str((calibration or {}).get("type", "identity")).strip().lower()
    if kind == "platt":
        z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), score * float(calibration.get("a", 1)) + float(calibration.get("b", 0))))
        return 1 / (1 + F.exp(-z))
    if kind in ("isotonic_bins", "score_bins"):
        inside = [F.when((score >= float(b.get("score_min", 0))) & (score <= float(b.get("score_max", 1))), F.lit(float(b["precision"])) if "precision" in b else score) for b in calibration.get("bins", [])]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*inside, score)))
    return score


def link_mentions(mentions: DataFrame, aliases: DataFrame, vocab: DataFrame, abbreviations: DataFrame | None = None, calibration: dict | None = None, k: int = TOP_K) -> DataFrame:
    """Each mention (mention_id, raw, status) with prediction, accepted, score, confidence, margin, reasons, top_k, stage.

    An alias or synonym settles a mention at 1.0. All others are scored against their candidates, once for each
    distinct term, and are accepted if no reason speaks against it. A mention that normalizes to nothing has the
    stage path_a_unresolved. Scores are rounded to six places before they are compared; ties go by label.
    """
    spark = mentions.sparkSession
    abbr = abbreviations if abbreviations is not None else spark.createDataFrame([], "abbr string, expanded string")
    abbr = abbr.select(X.drug_norm(F.col("abbr")).alias("abbr"), X.drug_norm(F.col("expanded")).alias("expanded")).where("abbr <> '' and expanded <> ''").groupBy("abbr").agg(F.max("expanded").alias("expanded"))
    uni = universe(aliases, vocab)
    first = uni.select("label", F.explode("synonyms").alias("term")).groupBy("term").agg(F.min("label").alias("exact"))
    m = mentions.select("mention_id", "raw", X.clean(F.col("status")).alias("status"), X.drug_norm(F.col("raw")).alias("norm"))
    m = m.join(R.alias_map(aliases).withColumnRenamed("alias", "norm"), "norm", "left").withColumn("term", F.coalesce("canonical", "norm")).drop("canonical").join(first, "term", "left")
    open_ = m.where("norm <> '' and exact is null").select(F.col("term").alias("mention")).distinct()
    c = candidates(open_, uni, abbr, k).join(uni, "label").join(abbr.withColumnRenamed("abbr", "mention"), "mention", "left")
    f = features(F.col("mention"), F.col("expanded"), F.col("edit"))
    score = sum((F.lit(w) * f[n] for n, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    c = c.select("mention", "label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("s"), F.struct(*[F.round(v, 6).alias(n) for n, v in f.items()]).alias("features"))
    c = c.select("mention", F.struct((-F.round("s", 6)).alias("neg"), (-F.round(calibrated(F.col("s"), calibration), 6)).alias("negc"), "label", "features").alias("x"))
    top = c.groupBy("mention").agg(F.array_sort(F.collect_list("x")).alias("x"))  # k candidates at most
    best = top.select("mention", F.transform("x", lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("score"), (-x["negc"]).alias("confidence"), x["features"].alias("features"))).alias("top_k"))
    b, second = F.col("top_k")[0], F.try_element_at("top_k", F.lit(2))
    best = best.select("mention", "top_k", b["label"].alias("best"), b["score"].alias("score"), b["confidence"].alias("confidence"), (b["score"] - F.coalesce(second["score"], F.lit(0.0))).alias("margin"), b["features"]["combo_partial_overlap_flag"].alias("combo"))
    j = m.join(best.withColumnRenamed("mention", "term"), "term", "left")
    n_words = F.size(F.filter(F.split("term", " "), lambda t: (t != "") & ~t.isin(*X.NOISE_TOKENS)))
    rules = [
        (F.length("term") < MIN_LENGTH, "mention_too_short"), (n_words == 0, "mention_noisy_or_empty"), (F.col("score") < MIN_SCORE, "score_below_min"),
        ((n_words <= 1) & (F.col("score") < MIN_SCORE_SHORT), "ambiguous_short_term"), (F.col("margin") < MIN_MARGIN, "low_margin_top1_top2"),
        (F.col("confidence") < MIN_CONFIDENCE, "confidence_below_target_precision"), (F.col("combo") > 0.5, "combo_single_agent_mismatch"), (F.col("status").isin(*OUT_OF_SCOPE), "out_of_scope_mention_status"),
    ]
    scored = F.when(F.col("best").isNull(), F.array(F.lit("no_candidates"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules])))
    empty, exact = F.col("norm") == "", F.col("exact").isNotNull()
    reasons = F.when(empty, F.array(F.lit("empty_after_normalization"))).when(exact, F.array(F.lit("deterministic_exact_match"))).otherwise(scored)
    j = j.withColumn("reasons", reasons).withColumn("accepted", ~empty & (exact | (F.size("reasons") == 0)))
    one = lambda c: F.when(empty, 0.0).when(exact, 1.0).otherwise(F.coalesce(c, F.lit(0.0)))
    stage = F.when(empty, "path_a_unresolved").when(exact, "path_a_exact_vocab").otherwise("path_b_canonical_transparent")
    return j.select("mention_id", "raw", "norm", "term", F.when(~F.col("accepted"), "").when(exact, F.col("exact")).otherwise(F.col("best")).alias("prediction"), "accepted", one(F.col("score")).alias("score"), one(F.col("confidence")).alias("confidence"), "margin", "reasons", F.when(~exact, F.col("top_k")).alias("top_k"), stage.alias("stage"))


def band_calibration(bands: DataFrame) -> dict:
    """A band table (band_min, band_max, n, accepted_precision) as the calibration that link_mentions takes."""
    rows = bands.where("n > 0").orderBy("band_min").collect()
    return {"type": "score_bins", "bins": [{"score_min": r["band_min"], "score_max": r["band_max"], "precision": r["accepted_precision"]} for r in rows]}


def _points(norm: str, label: str, seed: tuple) -> float:
    """How well a seed (norm, canonical, drugs) fits a reviewed term."""

    def shared(a: str, b: str) -> float:
        x, y = set(a.split()), set(b.split())
        return len(x & y) / len(x | y) if x | y else 1.0

    m, canon, drugs = seed
    hits = ((m == norm, 5), (bool(canon) and canon == label, 4), (norm in drugs, 6), (label in drugs, 5), (len(norm) >= 4 and norm in m, 1), (len(m) >= 4 and m in norm, 1))
    return sum(p for ok, p in hits if ok) + (shared(m, norm) if m else 0) + max((shared(d, norm) for d in drugs), default=0)


def _assign(batches):
    """Units for the reviewed terms of Arrow batches sorted by note, a note's seeds before its terms; a note may go on in the next batch."""
    memo: dict = {}
    kept, code, last = 0, None, []
    groups, units, used = {}, [], set()  # of one note: places of seeds by what they say, their units, those that are taken
    for b in batches:
        if not b.num_rows:
            continue
        codes, goes_on, last = R.key_codes(b.column("note_id"), last)
        code = codes[0] if goes_on else None
        norms, labels, ids = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("norm", "label", "unit_id"))
        drugs = b.column("drugs")
        drugs = [None] * len(codes) if drugs.null_count == len(codes) else drugs.to_pylist()
        is_seed = b.column("_seed")
        out = []
        for c, seed, norm, label, unit, d in zip(codes, is_seed.to_numpy(zero_copy_only=False).tolist(), norms, labels, ids, drugs):
            if c != code:
                code, groups, units, used = c, {}, [], set()
            if seed:
                says = (norm or "", label or "", tuple(d or ()))
                if says in groups:
                    groups[says].append(len(units))
                else:
                    groups[says] = deque((len(units),))
                units.append(unit)
                continue
            points = memo.get((norm, label))
            if points is None:
                points = memo[norm, label] = {}
            most, best, first, gone = 1, None, None, []
            for says, places in groups.items():
                while places and units[places[0]] in used:
                    places.popleft()
                if not places:
                    gone.append(says)
                    continue
                x = places[0]
                if first is None or x < first:
                    first = x
                n = points.get(says)
                if n is None:
                    n = points[says] = _points(norm, label, says)
                    kept += 1
                if n > most or n == most and (best is None or x < best):
                    most, best = n, x
            for says in gone:
                del groups[says]
            best = first if best is None else best
            out.append(None if best is None else units[best])
            if best is not None:
                used.add(units[best])
            if kept > MEMO:
                memo, kept = {}, 0
        terms = b.filter(pc.invert(is_seed))
        yield pa.RecordBatch.from_arrays([*[terms.column(c) for c in ("note_id", "pos", "norm", "label")], pa.array(out, pa.string())], ["note_id", "pos", "norm", "label", "unit_id"])


def assign_greedy(truth: DataFrame, seeds: DataFrame) -> DataFrame:
    """(note_id, pos, norm, label, unit_id, matched): each reviewed term of a note takes its best unused seed.

    truth: note_id, pos, norm, label; seeds: note_id, ord, unit_id, norm, canonical, drugs (array). Terms choose in
    order of pos; the best seed has one point or more, the first of equals wins; else the first unused seed is taken;
    without one unit_id is made from note, place and label. Seeds of one ord go by unit, norm and canonical, terms of one
    pos by norm and label. Notes are independent: one task sees a note whole, its seeds first, and keeps only those;
    seeds that say the same are looked at once.
    """
    kind = truth.schema["note_id"].dataType.simpleString()
    said = F.filter("drugs", lambda d: d != "")
    s = seeds.select("note_id", F.lit(True).alias("_seed"), "ord", F.lit(None).cast("int").alias("pos"), "norm", F.col("canonical").alias("label"), "unit_id", F.when(F.size(said) > 0, F.array_sort(F.array_distinct(said))).alias("drugs"))
    none = lambda c: F.lit(None).cast(s.schema[c].dataType).alias(c)
    t = truth.where("norm <> ''").select("note_id", F.lit(False).alias("_seed"), none("ord"), F.col("pos").cast("int").alias("pos"), "norm", "label", none("unit_id"), none("drugs"))
    order = [F.desc("_seed"), F.asc_nulls_last("ord"), F.asc_nulls_last("pos")]
    both = s.unionByName(t).repartition("note_id").sortWithinPartitions("note_id", *order, "unit_id", "norm", "label")
    got = both.mapInArrow(_assign, f"note_id {kind}, pos int, norm string, label string, unit_id string")
    made = X.stable_id("adj_", F.col("note_id"), F.concat(F.lit("jsonl_truth_"), F.col("pos") + 1), F.col("label"))
    return got.select("note_id", "pos", "norm", "label", F.coalesce("unit_id", made).alias("unit_id"), F.col("unit_id").isNotNull().alias("matched"))
