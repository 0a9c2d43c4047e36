"""Tables for reports and review: code descriptions, leftovers, review templates, counts, guardrails, lists resolved by visit."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.operators import linking as L
from noteloom.operators import relational as R
from noteloom.operators.evaluation import error_bucket, first_nonblank

# Column names of the review template, labels of bins and titles, stages of resolved lists.
IDENTITY = ("adjudication_unit_id", "person_id", "visit_id", "note_id", "span_id_or_local_reference")
CONTEXT = ("raw_mention_text", "context_text", "note_date", "note_title", "candidate_category", "target_drug", "seed_extracted_drugs_json", "seed_treatment_action", "seed_discontinuation_reason", "seed_certainty")
EDITABLE = ("adjudicated_canonical_label", "mention_status", "compare_to_structured_ehr", "reviewer_notes")
HELPERS = ("patha_term", "patha_prediction", "patha_correct", "pathb_prediction", "pathb_accepted", "pathb_score", "pathb_margin", "pathb_calibrated_confidence", "pathb_reason_codes_json", "pathb_top_k_candidates_json", "error_bucket")
NUMBERS, FLAGS = ("pathb_score", "pathb_margin", "pathb_calibrated_confidence"), ("patha_correct", "pathb_accepted")
LENGTH_LABELS = {"lt_250": "<250", "250_749": "250-749", "750_1499": "750-1499", "ge_1500": ">=1500"}
DENSITY_LABELS = {"1": "1", "2_3": "2-3", "4_7": "4-7", "8_plus": "8+"}
TITLE_LABELS = {"Progress Notes": "Progress Notes", "Assessment & Plan Note": "A&P Note", "Patient Instructions": "Pt Instructions", "H&P": "H&P", "Consults": "Consults"}
EXACT, EMBEDDED, OPEN = "path_a", "path_b_embedding_cpu", "path_a_unresolved"
LOW_CONFIDENCE = 0.9
# End of the fixed values.

MEMO = 20_000  # terms whose grams a worker remembers
WIDE = 64  # visits with more structured terms are scored by arrays


def code_map(codes: DataFrame) -> DataFrame:
    """(code, text) of condition code lines (ord, value): codes with and without dots, the last line of a code counts."""
    line = X.strip(F.col("value"))
    c, t = (F.regexp_extract(line, r"(?U)^([A-Z0-9.]+)\s+(.+)$", i) for i in (1, 2))
    m = codes.select("ord", c.alias("c"), F.lower(X.strip(t)).alias("text")).where("c <> '' and text <> ''")
    m = m.select("ord", "text", F.explode(F.array_distinct(F.array("c", F.replace("c", F.lit("."), F.lit(""))))).alias("code"))
    return m.groupBy("code").agg(F.max_by("text", "ord").alias("text"))


def procedure_map(codes: DataFrame) -> DataFrame:
    """(code, text) of order file lines (ord, value): number, code of seven, flag, short title, long title behind two spaces."""
    pattern = r"(?U)^\S+\s+([0-9A-HJ-NP-Z]{7})\s+\S+\s+.+?\s{2,}(.+)$"
    m = codes.select("ord", F.regexp_extract("value", pattern, 1).alias("code"), F.lower(X.strip(F.regexp_extract("value", pattern, 2))).alias("text"))
    return m.where("code <> '' and text <> ''").groupBy("code").agg(F.max_by("text", "ord").alias("text"))


def describe(rows: DataFrame, col: str, codes: DataFrame, tries: Column) -> DataFrame:
    """rows with `description`: the text of the first of the codes to try that the map has, else the value in lower case.

    Each distinct value is looked up once. Null is empty.
    """
    values = rows.select(X.strip(F.coalesce(F.col(col).cast("string"), F.lit(""))).alias("_v")).distinct()
    tried = values.select("_v", F.posexplode(tries).alias("_p", "code"))
    found = tried.join(codes, "code").groupBy("_v").agg(F.min_by("text", "_p").alias("_t"))
    out = R.left_join_nonblank(rows.withColumn("_v", X.strip(F.coalesce(F.col(col).cast("string"), F.lit("")))), found, "_v")
    return out.withColumn("description", F.coalesce("_t", F.lower("_v"))).drop("_v", "_t")


def condition_tries() -> Column:
    """Codes that a condition's value may stand for: its first word, then the whole, each without dots after that."""
    v = F.upper(F.col("_v"))
    plain = lambda c: F.replace(c, F.lit("."), F.lit(""))
    word = F.regexp_extract(v, r"(?U)^\S*", 0)
    return F.array(word, plain(word), v, plain(v))


def procedure_tries() -> Column:
    """Codes of seven in a procedure's value: the whole, then its parts between white space, commas, semicolons, bars and slashes."""
    v = F.upper(F.col("_v"))
    parts = F.transform(F.concat(F.array(v), F.split(v, r"(?U)[\s,;|/]+")), lambda c: F.replace(c, F.lit("."), F.lit("")))
    return F.filter(F.array_distinct(parts), lambda c: c.rlike("^[0-9A-HJ-NP-Z]{7}$"))


def leftovers(ladder: DataFrame) -> DataFrame:
    """Mentions of the ladder whose vocabulary entry, if any, is not the reviewed label in lower case."""
    gold = X.clean(F.col("gold"))
    return ladder.where(F.col("vocab_label") != gold).select("mention_id", F.coalesce("raw", F.lit("")).alias("raw"), F.col("a3").alias("patha_term"), (F.col("vocab_label") != "").alias("patha_exact_vocab_hit"), F.col("vocab_label").alias("patha_exact_vocab_label"), gold.alias("gold"))


def _small(rows: DataFrame, key: str, names: list[str], suffix: str) -> DataFrame:
    """One row a key, the first by `ord`, with those of the names that the table has."""
    own = [c for c in names if c in rows.columns]
    one = rows.groupBy(key).agg(F.min_by(F.struct(F.lit(1).alias("_one"), *own), "ord").alias("x"))
    return one.select(key, *[F.col(f"x.{c}").alias(c + suffix) for c in own])


def review_template(left: DataFrame, packets: DataFrame, reviewed: DataFrame, detail: DataFrame) -> DataFrame:
    """Leftovers with their packet, review and evaluation, in the columns that a reviewer gets: current values, and the same to edit.

    Packets and reviews, first row of a unit by `ord`, count where all five identity columns agree; the evaluation goes by
    unit alone. What no table has is blank, a number null, a flag false.
    """
    unit, rest = IDENTITY[0], list(IDENTITY[1:])
    out = left
    tables = ((packets, [c for c in CONTEXT if c != "raw_mention_text"], "_pkt"), (reviewed, ["raw_mention_text", "context_text", *EDITABLE], "_rev"))
    for table, names, suffix in tables:
        small = _small(table, unit, rest + names, suffix)
        same = [F.col(f"l.{unit}") == F.col(f"r.{unit}")] + [F.col(f"l.{c}") == F.col(f"r.{c}{suffix}") for c in rest]
        out = out.alias("l").join(small.alias("r"), same, "left").select("l.*", *[f"r.{c}" for c in small.columns if c != unit and c.removesuffix(suffix) not in rest])
    out = out.alias("l").join(_small(detail, unit, list(HELPERS), "_det"), unit, "left")
    of = lambda *names: first_nonblank(*[F.col(n).cast("string") for n in names if n in out.columns])

    def helper(c: str) -> Column:
        own = F.coalesce(*[F.col(n) for n in (c + "_det", c) if n in out.columns], F.lit(None))
        if c in NUMBERS:
            return own.try_cast("double")
        return F.coalesce(own.try_cast("boolean"), F.lit(False)) if c in FLAGS else F.coalesce(own.cast("string"), F.lit(""))

    order = {"raw_mention_text": ("raw_mention_text", "raw_mention_text_rev"), "context_text": ("context_text", "context_text_pkt", "context_text_rev")}
    context = [of(*order.get(c, (c, c + "_pkt"))).alias(c) for c in CONTEXT]
    current = {c: of(c + "_rev", c) for c in EDITABLE}
    return out.select(*IDENTITY, *context, *[v.alias("current_" + c) for c, v in current.items()], *[helper(c).alias("current_" + c) for c in HELPERS], F.lit("keep").alias("review_action"), *[v.alias(c) for c, v in current.items()])


def review_order() -> list[Column]:
    return [F.asc("current_error_bucket"), F.asc_nulls_last("current_pathb_score"), F.asc("note_id"), F.asc("adjudication_unit_id")]


def top_counts(rows: DataFrame, col: str, k: int = 25) -> DataFrame:
    """The k most frequent values, the smaller of equals first."""
    return rows.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def shares(rows: DataFrame, col: str) -> DataFrame:
    """(value, n, share of all) for each value."""
    g = rows.groupBy(col).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_total"))  # one row
    return g.crossJoin(F.broadcast(total)).select(col, "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"))


def status_counts(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(table, value, n): how often each value, in lower case, occurs in each of the columns; one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("table"), X.clean(F.col(c)).alias("value")) for c in cols]))
    return rows.select(each.alias("x")).groupBy("x.table", "x.value").agg(F.count("*").alias("n"))


def link_audit(detail: DataFrame, accepted: bool, k: int = 50) -> DataFrame:
    """The k surest links that were accepted, or that were not; ties by score and id."""
    return detail.where(F.coalesce("accepted", F.lit(False)) == accepted).orderBy(F.desc("confidence"), F.desc("score"), "id").limit(k)


def structured_gap(rows: DataFrame) -> DataFrame:
    """(status, compare, n) of mentions that structured records are not to be held against."""
    compare = F.lower(F.coalesce("compare", F.lit("")))
    return rows.where(compare != "yes").groupBy("status", "compare").agg(F.count("*").alias("n"))


def accuracy_steps(detail: DataFrame) -> DataFrame:
    """(step, method, accuracy, change, abstention, accepted precision) of baseline, deterministic and linked labels."""
    right = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    names = ("baseline", "path_a", "path_b")
    kept = F.coalesce("accepted", F.lit(False))
    one = detail.agg(*[right(n + "_correct").alias(n) for n in names], F.avg((~kept).cast("double")).alias("abstention"), F.try_divide(F.count_if(kept & F.col("path_b_correct")), F.count_if(kept)).alias("precision"))
    none = F.lit(None).cast("double")
    change = (none, F.col("path_a") - F.col("baseline"), F.col("path_b") - F.col("path_a"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("method"), F.round(n, 6).alias("accuracy"), F.round(change[i], 6).alias("delta"), (F.round(F.coalesce("abstention", F.lit(0.0)), 6) if i == 2 else none).alias("abstention"), (F.round(F.coalesce("precision", F.lit(0.0)), 6) if i == 2 else none).alias("precision")) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def pretty_slices(metrics: DataFrame) -> DataFrame:
    """Slices of candidate density, note length and the five titles of the report, under the labels it prints, to four places."""
    name, value = F.col("slice_name"), F.col("slice_value")
    label = lambda m: F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in m.items()], value)
    families = (("candidate_density_bin", "Candidate density", DENSITY_LABELS), ("note_length_bin", "Note length", LENGTH_LABELS), ("note_title_norm", "Note title", TITLE_LABELS))
    kept = metrics.where(name.isin("candidate_density_bin", "note_length_bin") & (value != "") | (name == "note_title_norm") & value.isin(*TITLE_LABELS))
    family = F.coalesce(*[F.when(name == n, F.lit(f)) for n, f, _ in families])
    pretty = F.coalesce(*[F.when(name == n, label(m)) for n, _, m in families])
    return kept.select(family.alias("slice_family"), pretty.alias("slice_value"), "tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def nonempty_metrics(pairs: DataFrame) -> DataFrame:
    """For each method, pairs of the same visit whose note has terms: how many, and the mean relaxed measures in percent."""
    mean = lambda c: F.round(F.coalesce(100 * F.avg(F.when(F.col("note_n") > 0, F.col(c).cast("double"))), F.lit(0.0)), 4).alias(c)
    return pairs.groupBy("method").agg(F.count_if(F.col("note_n") > 0).alias("n"), mean("containment_relaxed"), mean("has_overlap_relaxed"))


def guardrails(links: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """One row: rows (distinct `row`), accepted links for each row, the share of them below a confidence, their mean one."""
    ok = F.coalesce("accepted", F.lit(False))
    sure = F.when(ok, F.coalesce("confidence", "score", F.lit(0.0)).cast("double"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n = F.countDistinct("row")
    return links.agg(n.alias("n_rows"), rate(F.count_if(ok), n).alias("accept_rate"), rate(F.count_if(sure < low), F.count_if(ok)).alias("low_conf_accept_rate"), F.round(F.coalesce(F.avg(sure), F.lit(0.0)), 6).alias("mean_accept_conf"))


def lexicon_summary(lexicon: DataFrame, hits: DataFrame) -> DataFrame:
    """(category, terms, detections, notes) of each category of (category, term), with its hits (category, note_id), none too."""
    terms = lexicon.groupBy("category").agg(F.countDistinct("term").alias("terms"))
    by_note = hits.groupBy("category", "note_id").agg(F.count("*").alias("n"))
    found = by_note.groupBy("category").agg(F.sum("n").alias("detections"), F.count("*").alias("notes"))
    return terms.join(found, "category", "left").na.fill(0)


def top_score(cell: Column) -> Column:
    """The score of the first candidate in a JSON list; 0 where there is none that can be read."""
    return F.coalesce(F.get_json_object(cell, "$[0].score").try_cast("double"), F.lit(0.0))


def top_labels(cell: Column) -> Column:
    """The normalized labels of the candidates in a JSON list, blank ones left out; empty where it can not be read."""
    items = F.from_json(cell, "array<struct<canonical_label:string>>")
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<struct<canonical_label:string>>")), lambda x: X.drug_norm(x["canonical_label"])), lambda x: x != "")


def iso_date(c: Column) -> Column:
    """A written date or time as yyyy-MM-dd; null where it can not be read."""
    return F.date_format(F.try_to_timestamp(c.cast("string")), "yyyy-MM-dd")


def _grams(term: str) -> list[tuple[str, int]]:
    """relational.char_grams in Python, with how often each occurs."""
    p = f" {term} "
    return list(Counter([p[i : i + n] for n in (3, 4) for i in range(len(p) - n + 1)]).items())


def _fitted(labels: list[str], grams) -> Callable[[str], tuple[str | None, float]]:
    """The best of a visit's sorted distinct terms for another term, with its cosine to nine places; None where no gram is in common."""
    n, wide = len(labels), len(labels) > WIDE
    posts: dict = {}  # gram: places and counts
    for j, label in enumerate(labels):
        for g, tf in grams(label):
            p = posts.get(g)
            if p is None:
                p = posts[g] = (array("q"), array("d")) if wide else ([], [])
            p[0].append(j)
            p[1].append(tf)
    idfs = {d: math.log((1 + n) / (1 + d)) + 1 for d in {len(p[0]) for p in posts.values()}}
    norms = np.zeros(n) if wide else [0.0] * n
    for g, (js, tfs) in posts.items():
        idf = idfs[len(js)]
        if wide:
            js, w = np.asarray(js), np.asarray(tfs) * idf
            norms[js] += w * w
        else:
            w = [tf * idf for tf in tfs]
            for j, x in zip(js, w):
                norms[j] += x * x
        posts[g] = idf, js, w

    def best(term: str) -> tuple[str | None, float]:
        own, dots, square = grams(term), np.zeros(n) if wide else {}, 0.0
        for g, tf in own:
            p = posts.get(g)
            if p is None:
                square += tf * tf
                continue
            idf, js, w = p
            x = tf * idf
            square += x * x
            if wide:
                dots[js] += x * w
            else:
                for j, y in zip(js, w):
                    dots[j] = dots.get(j, 0.0) + x * y
        if wide:
            found = np.where(dots > 0, np.round(dots / np.sqrt(norms * square), 9), -1.0)
            j = int(found.argmax())  # the first of equals
            return (labels[j], float(found[j])) if found[j] >= 0 else (None, 0.0)
        top, at = -1.0, None
        for j, dot in dots.items():
            s = round(dot / math.sqrt(norms[j] * square), 9)
            if s > top or s == top and j < at:
                top, at = s, j
        return (None, 0.0) if at is None else (labels[at], top)

    return best


def _resolve(batches):
    """Stage, best label and score of the note terms in Arrow batches sorted by visit, a visit's structured terms before them; a visit may go on in the next batch."""
    grams = lru_cache(MEMO)(_grams)
    code, last, labels, best, before = None, [], [], None, None
    for b in batches:
        if not b.num_rows:
            continue
        codes, goes_on, last = R.key_codes(b.column("visit_id"), last)
        code = codes[0] if goes_on else None
        kept, stages, linked, scores = [], [], [], []
        for c, own, term in zip(codes, b.column("_own").to_numpy(zero_copy_only=False).tolist(), b.column("term").to_numpy(zero_copy_only=False).tolist()):
            if c != code:
                code, labels, known, best, before = c, [], set(), None, None
            if own:
                kept.append(False)
                if not labels or labels[-1] != term:
                    labels.append(term)
                continue
            kept.append(term != before)
            if term == before:
                continue
            before = term
            if best is None and labels:
                known, best = set(labels), _fitted(labels, grams)
            if best is None:
                stage, label, score = OPEN, None, 0.0
            elif term in known:
                stage, label, score = EXACT, term, 1.0
            else:
                stage, (label, score) = EMBEDDED, best(term)
            stages.append(stage)
            linked.append(label)
            scores.append(score)
        out = b.filter(pa.array(kept, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("visit_id"), out.column("term"), pa.array(stages, pa.string()), pa.array(linked, pa.string()), pa.array(scores, pa.float64())], ["visit_id", "term", "stage", "label", "_s"])


def resolve_lists(note: DataFrame, ehr: DataFrame, threshold: float) -> DataFrame:
    """Each note term (visit_id, term) against the structured terms of its own visit: stage, linked_to, score, accepted, mapped.

    A term that the visit has is settled. Another goes to the visit's term of the largest TF-IDF cosine over character
    grams, fitted on the visit's terms, and is mapped to it from the threshold on; visits without structured terms leave
    it as it is. Terms are taken once a visit; scores are rounded to nine places, ties go to the smaller. Terms are dealt
    by visit once, grams are not: one task sees a visit whole, its structured terms first, and keeps only those.
    """
    kind = note.schema["visit_id"].dataType.simpleString()
    e = ehr.where("term <> '' and visit_id is not null").select(F.col("visit_id").cast(kind).alias("visit_id"), F.lit(True).alias("_own"), "term")
    n = note.where("term <> ''").select("visit_id", F.lit(False).alias("_own"), "term")
    both = e.unionByName(n).repartition("visit_id").sortWithinPartitions("visit_id", F.desc("_own"), "term")
    out = both.mapInArrow(_resolve, f"visit_id {kind}, term string, stage string, label string, _s double")
    out = out.select("visit_id", "term", "stage", F.coalesce("label", F.lit("")).alias("linked_to"), F.round("_s", 6).alias("score"), "_s")
    ok = (F.col("linked_to") != "") & (F.col("_s") >= threshold)
    return out.withColumn("accepted", ok).withColumn("mapped", F.when(ok, F.col("linked_to")).otherwise(F.col("term"))).drop("_s")


def resolve_canonical(note: DataFrame, aliases: DataFrame, vocab: DataFrame) -> DataFrame:
    """(visit_id, mapped): sorted distinct labels of each visit's note terms (visit_id, term), by alias, vocabulary and the scored linker."""
    terms = note.select("term").distinct().withColumn("mention_id", F.col("term"))
    got = L.link_mentions(terms.select("mention_id", F.col("term").alias("raw"), F.lit("").alias("status")), aliases, vocab)
    mapped = F.when(F.col("accepted") & (F.coalesce("prediction", F.lit("")) != ""), F.col("prediction")).otherwise(F.col("got.term"))
    own = got.alias("got").select("mention_id", mapped.alias("mapped")).where("mapped <> ''")
    return note.distinct().join(own, note["term"] == own["mention_id"]).groupBy("visit_id").agg(F.array_sort(F.collect_set("mapped")).alias("mapped"))


def normalization_detail(mentions: DataFrame, aliases: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each mention (mention_id, raw, gold, status) with what ladder and linker make of it, whether each is right, and its error bucket.

    The baseline is the vocabulary's label of the lexical form; path A's is that of the decomposed one, or that form; path
    B's is the linker's prediction, accepted or not.
    """
    ladder = R.normalization_ladder(mentions.select("mention_id", "raw", "gold"), aliases, vocab)
    labels = L.universe(aliases, vocab).select("label", F.explode("synonyms").alias("term")).groupBy("term").agg(F.min("label").alias("label"))
    of = lambda key, name: labels.select(F.col("term").alias(key), F.col("label").alias(name))
    j = R.left_join_nonblank(R.left_join_nonblank(ladder, of("a2", "_base"), "a2"), of("a4", "_plain"), "a4")
    links = L.link_mentions(mentions.select("mention_id", "raw", "status"), aliases, vocab).select("mention_id", X.drug_norm(F.col("prediction")).alias("path_b"), "accepted", "score", "confidence", "margin", "reasons", "stage")
    j = j.join(links, "mention_id", "left").withColumn("gold", X.drug_norm(F.col("gold"))).withColumn("baseline", F.coalesce("_base", F.lit(""))).withColumn("path_a", F.coalesce("_plain", "a4")).drop("_base", "_plain")
    right = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False))
    j = j.select("*", right("baseline").alias("baseline_correct"), right("path_a").alias("path_a_correct"), ((F.col("path_b") != "") & right("path_b")).alias("path_b_correct"))
    return j.withColumn("error_bucket", error_bucket(F.col("gold"), F.col("baseline"), F.col("path_a"), F.col("path_b"), F.col("accepted"), F.col("reasons")))
