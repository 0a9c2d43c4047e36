"""From candidate spans to actions, reasons, certainty and entities, their visits, and packets for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.functions.spans import phrase_pattern

# Labels in order of priority, the four entity columns, and the cues in front of an entity.
ACTIONS = ("start", "stop", "hold", "dose_change")
DOMAINS = ("conditions", "drugs", "measurements", "procedures")
NEGATED = ("not", "no", "denies", "without")
UNCERTAIN = ("possible", "maybe", "possibly")
# End of the fixed values.

#: Anything up to the end of a sentence: an end mark with white space behind it, or a line end.
_WITHIN = r"(?:(?![.!?]\s|\n)[\s\S])*?"


def resolve_spans(spans: DataFrame, lexicon: dict[str, dict[str, tuple[str, ...]]], text: str = "span_text") -> DataFrame:
    """spans with treatment_action, discontinuation_reason, certainty and a sorted list of distinct lower-case terms for each domain.

    lexicon: `actions` and `reasons` by label, in order, and `entities` by domain. A phrase counts in any case and not
    beside a word character; of phrases that start at one place the longest counts. Without an action's phrase the
    first action one of whose verbs the text contains is taken. certainty is low where a cue stands before an entity
    of its sentence, or nothing was found, else high. Each distinct text is read once, and null is empty.
    """
    entities = {d: list(lexicon.get("entities", {}).get(d, ())) for d in DOMAINS}
    every = [t for g in ("actions", "reasons") for ts in lexicon.get(g, {}).values() for t in ts] + [t for ts in entities.values() for t in ts]
    t = F.col("_t")
    has = lambda terms: t.rlike(phrase_pattern(list(terms))) if terms else F.lit(False)
    first = lambda group, order: [F.when(has(lexicon.get(group, {}).get(k, ())), F.lit(k)) for k in order]
    cued = F.lit(False)
    if every:
        cue, found = (phrase_pattern(list(x)).removeprefix("(?iU)") for x in (NEGATED + UNCERTAIN, every))
        cued = t.rlike(f"(?iU){cue}{_WITHIN}{found}")
    texts = spans.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct()
    texts = texts.withColumn("treatment_action", F.coalesce(*first("actions", ACTIONS), X.fallback_action(t)))
    texts = texts.withColumn("discontinuation_reason", F.coalesce(*first("reasons", lexicon.get("reasons", {})), F.lit("none")))
    sure = ~cued & ((F.col("treatment_action") != "none") | (F.col("discontinuation_reason") != "none"))
    texts = texts.withColumn("certainty", F.when(sure, F.lit("high")).otherwise(F.lit("low")))
    for d, terms in entities.items():
        got = F.regexp_extract_all(t, F.lit(phrase_pattern(terms)), F.lit(0)) if terms else F.array().cast("array<string>")
        texts = texts.withColumn(d, F.array_sort(F.array_distinct(F.transform(got, lambda x: F.lower(F.trim(x))))))
    return spans.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).join(texts, "_t").drop("_t")


def visit_entities(spans: DataFrame, certain_only: bool = False) -> DataFrame:
    """One row for each person and visit, null ones too: spans, notes, and the sorted union of each list, of actions and reasons."""
    kept = spans.where(F.lower("certainty") == "high") if certain_only else spans
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    labels = lambda c, name: F.array_sort(F.collect_set(F.when(~F.lower(c).isin("", "none"), F.lower(c)))).alias(name)
    return kept.groupBy("person_id", "visit_id").agg(F.count("*").alias("n_spans"), F.countDistinct("note_id").alias("n_notes"), *[union(d) for d in DOMAINS], labels("treatment_action", "treatment_actions"), labels("discontinuation_reason", "discontinuation_reasons"))


SEED_KEYS = ("person_id", "visit_id", "note_id", "category", "span_text")


def _key(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)


def seed_lookup(resolved: DataFrame, order: str) -> DataFrame:
    """For each of the five keys: the drugs of all its rows, distinct and in order, and the first row's labels."""
    rows = resolved.select(*[_key(c) for c in SEED_KEYS], F.col(order).alias("_o"), "drugs", *[F.lower(F.trim(c)).alias(c) for c in ("treatment_action", "discontinuation_reason", "certainty")])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "drugs"))), lambda x: x["drugs"])
    first = [F.min_by(c, "_o").alias(f"seed_{c}") for c in ("treatment_action", "discontinuation_reason", "certainty")]
    return rows.groupBy(*SEED_KEYS).agg(F.array_distinct(F.flatten(listed)).alias("seed_drugs"), *first)


def mention_packets(candidates: DataFrame, seeds: DataFrame, span_id: str) -> DataFrame:
    """One row for each seed drug of a candidate span, or one without: unit id, text, context and the seed's labels."""
    own = candidates.select(*[_key(c) for c in SEED_KEYS], F.col(span_id).alias("span_id"))
    met = own.join(seeds, list(SEED_KEYS), "left").withColumn("seed_drugs", F.coalesce("seed_drugs", F.array().cast("array<string>")))
    rows = met.select("*", F.posexplode_outer("seed_drugs").alias("i", "drug"))
    ids = [F.col(c) for c in ("person_id", "visit_id", "note_id", "span_id")]
    unit = F.when(F.col("drug").isNull(), X.stable_id("adj_", *ids, F.lit("no_seed"))).otherwise(X.stable_id("adj_", *ids, F.col("drug"), F.col("i")))
    labels = [F.coalesce(f"seed_{c}", F.lit("")).alias(f"seed_{c}") for c in ("treatment_action", "discontinuation_reason", "certainty")]
    return rows.select(unit.alias("unit_id"), "person_id", "visit_id", "note_id", "span_id", F.coalesce("drug", F.lit("")).alias("raw_mention"), F.col("span_text").alias("context"), F.col("category").alias("candidate_category"), F.size("seed_drugs").alias("n_seed_drugs"), *labels)


def note_packets(candidates: DataFrame, notes: DataFrame, order: str) -> DataFrame:
    """One row for each note with candidates: their number, categories and first five texts, and what the notes table has of it."""
    own = candidates.withColumn("note_id", _key("note_id"))
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy("person_id", "visit_id", "note_id").orderBy(order)))
    five = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.struct("_r", F.coalesce("span_text", F.lit("")).alias("t"))))), lambda x: x["t"])
    g = ranked.groupBy("person_id", "visit_id", "note_id").agg(F.count("*").alias("span_count"), F.array_sort(F.collect_set("category")).alias("categories"), five.alias("span_examples"), F.min_by("note_title", "_r").alias("_title"))
    meta = notes.select(_key("note_id"), F.col("note_title").alias("_own"), "note_text", F.lit(1).alias("_hit")).dropDuplicates(["note_id"])
    text = F.coalesce("note_text", F.lit(""))
    return g.join(meta, "note_id", "left").select(
        X.stable_id("notepkt_", F.col("person_id"), F.col("visit_id"), F.col("note_id")).alias("packet_note_id"), "person_id", "visit_id", "note_id", F.coalesce("_own", "_title", F.lit("")).alias("note_title"), "span_count", "categories", "span_examples",
        F.substring(text, 1, 2000).alias("excerpt"), F.coalesce("_hit", F.lit(0)).alias("note_found"), (F.length(F.trim(text)) > 0).cast("int").alias("text_attached"),
    )


def packet_quality(mentions: DataFrame, notes: DataFrame, least: int = 20) -> DataFrame:
    """Counts of packets, notes and visits, how many contexts are there and long enough, and how many notes were found with text."""
    n = F.length("context")
    a = mentions.agg(F.count("*").alias("mentions"), F.countDistinct("note_id").alias("notes"), F.countDistinct("person_id", "visit_id").alias("visits"), F.avg((n > 0).cast("double")).alias("present_rate"), F.avg((n >= max(least, 1)).cast("double")).alias("sufficient_rate"))
    b = notes.agg(F.count("*").alias("packets"), F.sum("note_found").alias("found"), F.sum("text_attached").alias("attached"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("present_rate", none(F.col("present_rate"))).withColumn("sufficient_rate", none(F.col("sufficient_rate"))).withColumn("attached_rate", none(F.try_divide("attached", "packets"))).withColumn("attached_when_found", none(F.try_divide("attached", "found")))


def attach_text(rows: DataFrame, source: DataFrame, order: str) -> DataFrame:
    """rows with full_text, by note id as text; of a note's rows in the source the last by order counts."""
    last = source.groupBy(F.trim(F.col("note_id").cast("string")).alias("_n")).agg(F.max_by("note_text", order).alias("full_text"))
    return rows.withColumn("_n", F.trim(F.col("note_id").cast("string"))).join(last, "_n", "left").drop("_n")


def restrict(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are among those given, each once; null keys match none."""
    return rows.join(keys.select(*on), on, "left_semi")


def first_keys(rows: DataFrame, on: list[str], n: int) -> DataFrame:
    """Rows of the first n distinct keys in their order."""
    return restrict(rows, F.broadcast(rows.select(*on).distinct().orderBy(*on).limit(n)), on)


def cap_in_order(rows: DataFrame, person: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each person."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(person).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def pseudo_timeline(visits: DataFrame) -> DataFrame:
    """(person_id, visit_id, rank, day) of distinct visits without dates: numeric ids first, by number, then by text; day 2000-01-01 + rank."""
    own = visits.select("person_id", F.col("visit_id").cast("string").alias("visit_id")).distinct()
    number = F.col("visit_id").try_cast("double")
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(number.asc_nulls_last(), "visit_id"))
    return own.withColumn("rank", rank).withColumn("day", F.date_add(F.lit("2000-01-01").cast("date"), F.col("rank")))


def layered(accepted: Column, label: Column, fallback: Column) -> Column:
    """The linker's label where it is accepted and not blank, else the deterministic one."""
    return F.when(F.coalesce(accepted, F.lit(False)) & (F.trim(F.coalesce(label, F.lit(""))) != ""), label).otherwise(fallback)


def ablation(rows: DataFrame, methods: dict[str, Column], visit: list[str], gold: DataFrame, status: str) -> DataFrame:
    """For each method, over all rows and for each status: visits, how many share a value with gold's list, mean share of gold found.

    rows have one value a row; a visit's values are gathered anew for each status. gold: visit keys and `truth` (array).
    """
    long = rows.select(*visit, status, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("value")) for m, c in methods.items()])).alias("x")).select(*visit, status, "x.*")
    both = long.select(*visit, "method", "value", F.explode(F.array(F.lit("all"), F.col(status))).alias("status"))
    got = both.groupBy(*visit, "method", "status").agg(F.collect_set(F.when(F.col("value") != "", F.col("value"))).alias("values"))
    met = got.join(gold, visit)
    common = F.size(F.array_intersect("values", "truth"))
    found = F.when(F.size("truth") > 0, common / F.size("truth")).otherwise(0.0)
    return met.groupBy("method", "status").agg(F.count("*").alias("visits"), F.avg((common > 0).cast("double")).alias("overlap_rate"), F.avg(found).alias("containment"))


def set_sensitivity(rows: DataFrame, visit: list[str], a: str, b: str) -> DataFrame:
    """How far two value columns agree as sets of a visit: visits, rate of equal sets, mean Jaccard (0 of two empty ones), sizes."""
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    g = rows.groupBy(*visit).agg(of(a).alias("x"), of(b).alias("y"))
    j = F.coalesce(F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))), F.lit(0.0))
    size = lambda c: [F.avg(F.size(c)).alias(f"mean_{c}"), F.median(F.size(c)).alias(f"median_{c}")]
    return g.agg(F.count("*").alias("visits"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("equal_rate"), F.avg(j).alias("jaccard"), *size("x"), *size("y"))


def value_counts(rows: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """(value, n) with <EMPTY> for null and blank, most frequent first, ties by value; the first k if k is given."""
    g = rows.groupBy(F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("<EMPTY>")).alias("value")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "value").limit(k) if k is not None else g


def overlap_ratio(a: Column, b: Column) -> Column:
    """Tokens in common over all tokens of both; 0 where either has none."""
    of = lambda c: F.filter(F.array_distinct(F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+")), lambda t: t != "")
    x, y = of(a), of(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def operating_point(bands: DataFrame, target: float) -> DataFrame:
    """The lowest band whose precision meets the target and that has rows; none if there is none."""
    return bands.where((F.col("n") > 0) & (F.col("precision") >= target)).orderBy("band").limit(1)
