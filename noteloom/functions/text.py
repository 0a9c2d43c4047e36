"""Column expressions for term normalization, matching, identifiers and bins; all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words, phrases and patterns that right results need.
NOISE_TOKENS = ("diagnosis", "history", "present", "illness", "surgeon", "allergies", "problem", "medications", "medication", "note", "other", "status", "patient", "location", "agreement", "assessment", "pain")
DOSE = r"\b\d+(\.\d+)?\s*(mg|mcg|g|ml|l|unit|units|%)\b"
ROUTE = r"\b(po|iv|im|sc|subq|subcutaneous|intravenous|oral|topical|pf)\b"
FORM = r"\b(tablet|tabs?|capsule|caps|solution|syrup|injection|injectable|ointment|spray|suspension|patch|cream|drop|drops)\b"
J_CODE = r"\bj\d{4,6}\b"
NDC = r"\bndc[:\s-]*\d+\b"
SITE_NOISE = r"\b(builder|carrier fluid|irrigation|vumc|o r)\b"
EXACT_NOISE = ("diagnosis", "history", "history of present illness", "problem list", "medications", "medication management", "pain assessment", "assessment", "allergies", "location", "status", "patient", "other")
CONTAINED_NOISE = r"\b(history of present illness|problem list|medication management|pain assessment|review of systems|chief complaint)\b"
TEMPLATE_MARKERS = ("template", "autopopulated", "auto populated", "boilerplate", "smartphrase", "dotphrase")
STATUSES = ("active_current", "newly_started_or_prescribed", "planned_or_considering", "discontinued_or_stopped", "held_or_paused", "historical_prior", "reference_only_or_discussion_only", "unclear")
GROUPED = {"active_current": "current_or_intended", "newly_started_or_prescribed": "current_or_intended", "planned_or_considering": "current_or_intended", "discontinued_or_stopped": "not_current", "held_or_paused": "not_current", "historical_prior": "not_current", "reference_only_or_discussion_only": "not_current", "unclear": "unclear"}
LAB_TERMS = ("amylase", "calcium", "cholesterol", "collagen", "creatinine", "fructose", "glucose", "iodine", "iron", "lactase", "lactate", "lactose", "lipase", "lycopene", "magnesium", "potassium", "sodium")
VAGUE = r"\bchemo(?:therapy)?\b|\bimmunotherapy\b|\bhormone therapy\b|\bpain (?:med|medication)\b|\bblood pressure (?:med|medication)\b|\bmedications?\b|\btherapy\b|\btreatment\b"
COMBO = r"(?:/|\+|\band\b|\bwith\b|\bplus\b)"
SALTS = r"\b(?:hcl|hydrochloride|sodium|succinate|acetate|phosphate|citrate|tartrate|mesylate|besylate|fumarate|maleate)\b"
FORMS = r"\b(?:tablet|capsule|injection|solution|suspension|patch|cream|ointment|er|xr|sr|dr|ir)\b"
REVIEW_FORMS = r"\b(?:er|xr|sr|dr|cr|ir|inj|injection|tablet|capsule|solution|suspension|cream|ointment|patch)\b"
ABBREVIATIONS = ("5fu", "adt", "atezo", "bev", "folfiri", "folfirinox", "folfox", "io", "prn")
UNCLEAR = r"\bmed(?:ication)?s?\b|\bdrug\b|\btherapy\b|\btreatment\b|\bregimen\b"
SHORT_TERMS = ("ct", "mri", "pet", "psa", "hiv", "bmi", "ecg", "ekg", "a1c", "cbc", "cmp", "bun", "ast", "alt", "wbc", "hgb", "hct", "plt", "bp", "hr", "rr", "spo2", "fev1", "fev")
NOISY_TERMS = ("date", "time", "day", "name", "report", "position", "form", "location", "perform", "performed", "authorized", "chief", "complaint", "pain", "side", "ic", "pe", "ph", "ga", "cry", "tin", "water", "driving")
ACTION_VERBS = (
    ("start", ("started", "initiated", "began", "prescribed", "continue", "continued", "resume", "resumed")),
    ("stop", ("stopped", "discontinued", "ceased", "d/c", "dc'd")),
    ("hold", ("hold", "held", "on hold", "paused")),
    ("dose_change", ("increased", "decreased", "reduced", "adjusted")),
)
# End of the fixed values.

U = "(?U)"  # Python's classes are Unicode's


def strip(c: Column) -> Column:
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Trimmed, lower-cased, null as empty."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, U + r"\s+", " "))


def surface(c: Column) -> Column:
    return collapse(clean(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def informative(c: Column, noise: bool = True) -> Column:
    return F.filter(F.split(c, " "), lambda t: (F.length(t) >= 3) & (~t.isin(*NOISE_TOKENS) if noise else F.lit(True)))


def _stripped(c: Column, drugs: bool) -> Column:
    t = F.regexp_replace(clean(c), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, "[/_-]", " ")
    if drugs:
        for p in (DOSE, ROUTE, FORM, J_CODE, NDC, SITE_NOISE):
            t = F.regexp_replace(t, U + p, " ")
    return collapse(F.regexp_replace(t, U + r"[^a-z0-9\s]", " "))


def drug_norm(c: Column, keep: int = 4, noise: bool = True) -> Column:
    """A drug mention's first informative words; keep=3, noise=False is the structured records' preset."""
    return F.array_join(F.slice(informative(_stripped(c, True), noise), 1, keep), " ")


def term_norm(c: Column, domain: str) -> Column:
    """The concordance preset: codes, numbers and pure noise become empty."""
    t = _stripped(c, domain == "drugs")
    gone = t.rlike(r"^[a-z]\d{2,6}$") | t.rlike(r"^\d{3,8}$") | t.isin(*NOISE_TOKENS)
    if domain in ("measurements", "procedures"):
        gone = gone | t.isin(*EXACT_NOISE) | t.rlike(U + CONTAINED_NOISE)
    out = F.array_join(F.slice(informative(t), 1, 3), " ") if domain == "drugs" else t
    return F.when(gone, F.lit("")).otherwise(out)


def relaxed_match(a: Column, b: Column) -> Column:
    """Equal, or one of at least four characters within the other, or half of the smaller informative word set shared."""
    ta, tb = F.array_distinct(informative(a)), F.array_distinct(informative(b))
    least = F.least(F.size(ta), F.size(tb))
    shared = F.size(F.array_intersect(ta, tb))
    near = (F.length(a) >= 4) & b.contains(a) | (F.length(b) >= 4) & a.contains(b) | (shared > 0) & (shared / F.greatest(least, F.lit(1)) >= 0.5)
    return F.coalesce((a != "") & (b != "") & ((a == b) | near), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def containment(note: Column, other: Column) -> Column:
    return F.when(F.size(note) == 0, 1.0).when(F.size(other) == 0, 0.0).otherwise(F.size(F.array_intersect(note, other)) / F.size(note))


def relaxed_containment(note: Column, other: Column) -> Column:
    hits = F.size(F.filter(note, lambda n: F.exists(other, lambda e: relaxed_match(n, e))))
    return F.when(F.size(note) == 0, 1.0).when(F.size(other) == 0, 0.0).otherwise(hits / F.size(note))


def relaxed_overlap(note: Column, other: Column) -> Column:
    return F.when(F.exists(note, lambda n: F.exists(other, lambda e: relaxed_match(n, e))), 1).otherwise(0)


def list_cell(c: Column) -> Column:
    """A JSON or Python list literal as sorted distinct lower-case strings; junk, blank and null are empty."""
    parsed = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parsed, clean), lambda x: x != "")))


def number_id(c: Column) -> Column:
    return c.cast("string").try_cast("double").try_cast("long")


def string_id(c: Column) -> Column:
    t = strip(c.cast("string"))
    return F.when(F.lower(t).isin("", "nan", "none"), F.lit(None).cast("string")).otherwise(F.regexp_replace(t, r"\.0+$", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16))


def template_like(c: Column) -> Column:
    t = clean(c)
    return (F.length(t) < 40) | t.rlike("|".join(TEMPLATE_MARKERS))


def grouped_status(c: Column) -> Column:
    t = clean(c)
    return F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in GROUPED.items()], F.lit("unclear"))


def _bin(c: Column, cuts: list[tuple[float, str]], last: str, null: str) -> Column:
    out = F.when(c.isNull(), F.lit(null))
    for most, name in cuts:
        out = out.when(c <= most, F.lit(name))
    return out.otherwise(F.lit(last))


def note_length_bin(c: Column, compat: bool = False) -> Column:
    """compat: a null length counts as the longest bin."""
    return _bin(c, [(249, "lt_250"), (749, "250_749"), (1499, "750_1499")], "ge_1500", "ge_1500" if compat else "unknown")


def density_bin(c: Column, compat: bool = False) -> Column:
    return _bin(c, [(0, "0"), (1, "1"), (3, "2_3"), (7, "4_7")], "8_plus", "8_plus" if compat else "unknown")


def visit_count_bin(c: Column) -> Column:
    return _bin(c, [(1, "01"), (3, "02-03"), (6, "04-06"), (12, "07-12")], "13+", "13+")


def candidate_count_bin(c: Column) -> Column:
    return _bin(c, [(0, "00"), (1, "01"), (3, "02-03"), (7, "04-07")], "08+", "08+")


def mention_density_bin(c: Column) -> Column:
    return _bin(c, [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "4")], ">=5", ">=5")


def short_or_abbreviation(norm: Column, raw: Column) -> Column:
    compact = F.regexp_replace(strip(raw), "[^A-Za-z0-9]", "")
    one = (F.size(tokens(norm)) == 1) & (F.length(norm) <= 4)
    return (norm == "") | norm.isin(*ABBREVIATIONS) | one | (compact != "") & (F.length(compact) <= 4) | strip(raw).rlike("^[A-Z]{2,6}$")


def failure_category(raw: Column, norm: Column, gold: Column) -> Column:
    """Why a mention was not resolved: the first rule that holds."""
    r, n, g = clean(raw), clean(norm), clean(gold)
    combo = "|".join((COMBO, SALTS, FORMS))
    return (
        F.when(F.arrays_overlap(tokens(n), F.array(*map(F.lit, LAB_TERMS))), "lab/substance/non-medication")
        .when(r.rlike(U + VAGUE), "vague class term")
        .when(r.rlike(U + combo) | g.rlike(U + combo), "combination/formulation mismatch")
        .when(short_or_abbreviation(n, r), "ambiguous abbreviation")
        .when((n == "") | r.rlike(U + UNCLEAR), "unclear canonical target")
        .otherwise("missing alias")
    )


def combo_like(raw: Column) -> Column:
    return clean(raw).rlike(U + "|".join((COMBO, SALTS, REVIEW_FORMS)))


def mention_safe(term: Column, entity_type: str) -> Column:
    """Whether a lexicon term is specific enough to be looked for in notes."""
    t = clean(term)
    single = ~t.rlike("[ /-]")
    bad = (t == "") | (F.length(t) > 120) | ~t.rlike("[a-z0-9]")
    bad = bad | single & ((F.length(t) <= 2) & ~t.isin(*SHORT_TERMS) | t.rlike(U + r"^\p{L}{3}$") & ~t.isin(*SHORT_TERMS) | t.isin(*NOISY_TERMS))
    if entity_type == "measurements":
        bad = bad | t.isin(*NOISY_TERMS) | (F.length(t) <= 3) & ~t.isin(*SHORT_TERMS)
    return ~bad


def fallback_action(text: Column) -> Column:
    """The first action one of whose verbs the text contains, as a substring, else none."""
    t = F.lower(text)
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, verbs)), lambda v: t.contains(v)), F.lit(a)) for a, verbs in ACTION_VERBS], F.lit("none"))
