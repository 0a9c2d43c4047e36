"""Evaluation of normalized mentions: error buckets, leftovers, lint of alias tables, hints and slices for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.operators.resolution import overlap_ratio

# Buckets, issues, hints and the patterns and words that decide them.
BUCKETS = ("pathb_recovered_leftover", "alias_miss", "patha_solved", "vocabulary_miss", "ambiguous_abbreviation", "pathb_abstained", "false_link", "baseline_exact", "tokenization_or_cleanup_miss")
SHORT_REASONS = ("mention_too_short", "ambiguous_short_term")
SCORED_STAGE, EXACT_STAGE = "path_b_canonical_transparent", "path_a_exact_vocab"
FORM_PATTERN = r"/|\+|\b(?:with|and|plus|xr|er|ir|tablet|capsule|patch)\b"
SUBSTANCE_PATTERN = r"\b(?:calcium|sodium|glucose|iron|creatinine|collagen|lactate)\b"
STOP_REASONS = ("completion", "toxicity", "progression", "cost", "logistics", "patient_preference")
HINTS = {"start": "newly_started", "hold": "held_paused", "stop": "discontinued_stopped", "dose_change": "active_current"}
CATEGORIES = ("ambiguous abbreviation", "vague class term", "lab/substance/non-medication", "combination/formulation mismatch", "missing alias", "unclear canonical target")
UNKNOWN_SERVICE = "<UNKNOWN_SERVICE>"
# End of the fixed values.


def error_bucket(gold: Column, baseline: Column, plain: Column, linked: Column, accepted: Column, reasons: Column) -> Column:
    """Which of nine things became of a mention: baseline, deterministic and linked labels against the reviewed one."""
    text = lambda c: F.coalesce(c, F.lit(""))
    gold, baseline, plain, linked = map(text, (gold, baseline, plain, linked))
    accepted = F.coalesce(accepted, F.lit(False))
    of = lambda *names: F.arrays_overlap(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    right, open_ = plain == gold, (plain != gold) & ~accepted
    rules = (~right & (linked == gold) & accepted, right & (baseline != gold), right & (linked == gold), open_ & of("no_candidates"), open_ & of(*SHORT_REASONS), open_, accepted & (linked != "") & (linked != gold), baseline == gold)
    return F.coalesce(*[F.when(r, F.lit(b)) for r, b in zip(rules, BUCKETS)], F.lit(BUCKETS[-1]))


def leftover_metrics(rows: DataFrame) -> DataFrame:
    """Of mentions that the deterministic path missed: how many there are, were accepted and recovered, with precision and
    rates; once for all (`loose`) and once for those of the scored stage alone (`strict`)."""
    left = rows.where("not patha_correct").select(F.col("pathb_accepted").alias("a"), (F.col("pathb_accepted") & F.col("pathb_correct")).alias("r"), (F.col("pathb_stage") == SCORED_STAGE).alias("s"))
    both = left.select("a", "r", F.explode(F.array(F.struct(F.lit("loose").alias("kind"), F.lit(True).alias("k")), F.struct(F.lit("strict").alias("kind"), F.col("s").alias("k")))).alias("x")).select("a", "r", "x.*")
    every = rows.sparkSession.range(1).select(F.explode(F.array(F.lit("loose"), F.lit("strict"))).alias("kind"))
    g = both.where("k").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("a").alias("accepted"), F.count_if("r").alias("recovered"))
    g = every.join(g, "kind", "left").na.fill(0)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return g.withColumn("accepted_precision", rate("recovered", "accepted")).withColumn("recovery_rate", rate("recovered", "n")).withColumn("abstention_rate", rate(F.col("n") - F.col("accepted"), F.col("n")))


def alias_lint(aliases: DataFrame) -> DataFrame:
    """(alias, canonical, issue) of included alias rows: several labels for one alias; else too short, no word in common
    with the label, or a low confidence, whichever comes first."""
    use = aliases.where("include").select(X.drug_norm(F.col("alias_raw")).alias("alias"), X.drug_norm(F.col("canonical")).alias("canonical"), X.clean(F.col("confidence")).alias("confidence"))
    many = use.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("c")).where("size(c) > 1").select("alias", F.array_join("c", "|").alias("canonical"), F.lit("non_one_to_one_alias").alias("issue"))
    issue = F.when(F.length("alias") <= 3, "very_short_alias").when(overlap_ratio(F.col("alias"), F.col("canonical")) == 0, "zero_token_overlap").when(F.col("confidence").isin("low", "uncertain"), "low_confidence_mapping")
    own = use.where("alias <> '' and canonical <> ''").select("alias", "canonical", issue.alias("issue")).where("issue is not null")
    return many.unionByName(own).distinct()


def suspicious(mention: Column, label: Column, margin: Column) -> Column:
    """Whether an accepted link shares no word with its mention, has a mention of four characters or fewer, or a margin under 0.08."""
    return (overlap_ratio(mention, label) == 0) | (F.length(F.coalesce(mention, F.lit(""))) <= 4) | (margin < 0.08)


def follow_up(term: Column) -> Column:
    t = X.clean(term)
    return F.when(t.rlike(X.U + FORM_PATTERN), "Formulation/combo review").when(t.rlike(X.U + SUBSTANCE_PATTERN), "Substance/non-med review").otherwise("Alias/vocabulary review")


def status_hint(action: Column, reason: Column) -> Column:
    a, r = X.clean(action), X.clean(reason)
    return F.coalesce(*[F.when(a == k, F.lit(v)) for k, v in HINTS.items()], F.when(r.isin(*STOP_REASONS), F.lit("discontinued_stopped")), F.lit("active_current"))


def strict_slice(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Missed mentions that no exact vocabulary entry decided, with the columns asked for; those that lack come as blank,
    a lacking reviewed label as the gold one, a lacking current bucket as the error bucket."""
    instead = {"adjudicated_canonical_label": "gold_canonical", "current_error_bucket": "error_bucket"}
    of = lambda c: F.col(c).cast("string") if c in rows.columns else F.col(instead[c]).cast("string") if instead.get(c) in rows.columns else F.lit("")
    return rows.where(~F.col("patha_correct") & (F.trim("pathb_stage") != EXACT_STAGE)).select(*[of(c).alias(c) for c in columns])


def entity(c: Column, is_id: bool = False) -> Column:
    """A structured entity trimmed and in lower case, ids marked as such; null for a blank or a written null."""
    t = X.clean(c.cast("string"))
    t = F.concat(F.lit("concept_id:"), t) if is_id else t
    return F.when(~t.isin("", "nan", "none"), t)


def service_mode(notes: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent service of each visit, the smaller of equals; a placeholder where there is none."""
    return notes.groupBy(*keys).agg(F.coalesce(F.mode("service", True), F.lit(UNKNOWN_SERVICE)).alias("service"))


def taxonomy_table(failures: DataFrame) -> DataFrame:
    """(category, n, percent) of all six categories, those without failures too."""
    every = failures.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    g = every.join(failures.groupBy("category").agg(F.count("*").alias("n")), "category", "left").na.fill(0)
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("percent", F.round(100 * F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), 2))


def taxonomy_examples(failures: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent mentions of each category with their most frequent label; ties by text."""
    pairs = failures.groupBy("category", F.lower("raw").alias("mention"), F.lower("gold").alias("gold")).agg(F.count("*").alias("n"))
    g = pairs.groupBy("category", "mention").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "gold"))["gold"].alias("gold"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "mention"))).where(F.col("_r") <= k).drop("_r")


def failure_cause(totals: DataFrame) -> DataFrame:
    """Why an extraction gave no entities: one row with terms, detections, mentions and filled, and the first cause that fits."""
    cause = (
        F.when(F.col("terms") == 0, "no_ehr_entity_lexicons_loaded").when(F.col("detections") == 0, "no_raw_medspacy_detections")
        .when(F.col("mentions") == 0, "raw_detections_filtered_or_not_mapped_to_entity_labels").when(F.col("filled") == 0, "serialization_or_output_contract_issue").otherwise("none")
    )
    return totals.withColumn("likely_failure_point", cause)


def sample(rows: DataFrame, row_id: str, n: int, seed: str) -> DataFrame:
    """n rows drawn by a hash that reruns repeat."""
    return rows.orderBy(F.sha1(F.concat(F.lit(seed), F.col(row_id).cast("string"))), row_id).limit(n)


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def unmatched_visits(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Visits of the same day (k = 0) whose notes have terms of which none meets a structured one, with both lists; the first n by visit."""
    out = pairs.where((F.size("note_terms") > 0) & ~F.exists("note_terms", lambda a: F.exists("ehr_terms", lambda b: (a == b) | F.contains(a, b) | F.contains(b, a))))
    return out.orderBy("visit_id").limit(n) if n is not None else out


def cooccurring(texts: DataFrame, key: str, seeds: list[str], stop: tuple[str, ...], most: int = 3, least: int = 3) -> DataFrame:
    """(ngram, n) of 1 to `most` words in sentences that hold a seed phrase, but for stop words at either end and n below
    least; each sentence counts as often as it occurs."""
    sentence = F.explode(F.split(F.lower("text"), r"(?<=[.!?])\s+|\n+")).alias("s")
    hit = texts.select(key, sentence).where(" or ".join(f"contains(s, '{x}')" for x in seeds))
    words = hit.select(F.regexp_extract_all("s", F.lit("[a-z0-9']+"), F.lit(0)).alias("w")).where("size(w) > 0")
    none = F.array().cast("array<array<string>>")

    def of(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.slice(F.col("w"), i + 1, k))
        return F.when(F.size("w") >= k, every).otherwise(none)

    grams = [of(k) for k in range(1, most + 1)]
    g = words.select(F.explode(F.flatten(F.array(*grams))).alias("g")).where(~F.element_at("g", 1).isin(*stop) & ~F.element_at("g", -1).isin(*stop))
    return g.groupBy(F.array_join("g", " ").alias("ngram")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
