"""Golden cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import spans as S
from noteloom.functions import text as X
from noteloom.operators import relational as R


def value(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


DRUGS = [
    ("Taxol 175 mg IV", "taxol", "taxol", "taxol"),
    ("Carbo/Taxol", "carbo taxol", "carbo taxol", "carbo taxol"),
    ("5-FU", "", "", ""),
    ("Vitamin D 5000 units (oral)", "vitamin", "vitamin", "vitamin"),
    ("NDC: 12345 heparin", "heparin", "heparin", "heparin"),
    ("5% dextrose", "dextrose", "dextrose", "dextrose"),
    ("ado-trastuzumab emtansine (Kadcyla)", "ado trastuzumab emtansine", "ado trastuzumab emtansine", "ado trastuzumab emtansine"),
    ("pain medication", "", "", "pain medication"),
    ("J9267 paclitaxel injection", "paclitaxel", "paclitaxel", "paclitaxel"),
    ("carrier fluid sodium chloride 0.9 % irrigation", "sodium chloride", "sodium chloride", "sodium chloride"),
    ("insulin glargine recombinant human analog pen", "insulin glargine recombinant human", "insulin glargine recombinant", "insulin glargine recombinant"),
    ("carrier.fluid saline", "carrier fluid saline", "carrier fluid saline", "carrier fluid saline"),
]


def test_normalizers(spark):
    df = spark.createDataFrame(DRUGS, "raw string, a string, b string, c string")
    for r in df.select("*", X.drug_norm(F.col("raw")).alias("x"), X.term_norm(F.col("raw"), "drugs").alias("y"), X.drug_norm(F.col("raw"), 3, False).alias("z")).collect():
        assert (r["x"], r["y"], r["z"]) == (r["a"], r["b"], r["c"]), r["raw"]
    for raw, domain, want in [("C06.0", "conditions", "c06 0"), ("I10", "conditions", ""), ("12345", "conditions", ""), ("Pain", "conditions", ""), ("Review of Systems: normal", "measurements", ""), ("CT chest w/o contrast", "procedures", "ct chest w o contrast")]:
        assert value(spark, X.term_norm(F.lit(raw), domain)) == want


def test_relaxed_match(spark):
    for a, b, want in [("taxol", "paclitaxel", False), ("axel", "paclitaxel", True), ("sodium chloride", "sodium phosphate dibasic", True), ("abc", "abcd", False), ("small ring", "red ring", True), ("a b", "a b c", False), ("", "x", False)]:
        assert value(spark, X.relaxed_match(F.lit(a), F.lit(b))) is want, (a, b)


def test_set_measures_of_empties(spark):
    none, one = F.array().cast("array<string>"), F.array(F.lit("x"))
    assert value(spark, X.jaccard(none, none)) == 1 and value(spark, X.jaccard(none, one)) == 0
    assert value(spark, X.containment(none, one)) == 1 and value(spark, X.containment(one, none)) == 0
    assert value(spark, X.relaxed_containment(none, one)) == 1 and value(spark, X.relaxed_overlap(none, one)) == 0


def test_sentences_and_phrases(spark):
    s = lambda t: [(x["begin"], x["end"]) for x in value(spark, S.sentences(F.lit(t)))]
    assert s("Start taxol. Hold herceptin!\n\nDose 1.5 mg") == [(0, 13), (13, 30), (30, 41)]
    assert s("") == [(0, 0)] and s("no end") == [(0, 6)]
    m = lambda t, w: [(x["begin"], x["match"]) for x in value(spark, S.matches(F.lit(t), S.phrase_pattern(w)))]
    assert m("Patient started taxol today. Will hold herceptin due to toxicity.", ["start", "started", "hold", "toxicity"]) == [(8, "started"), (34, "hold"), (56, "toxicity")]
    assert m("éstop STOPÉ İstop stop", ["stop"]) == [(18, "stop")]


def test_ids_bins_and_cells(spark):
    assert value(spark, X.stable_id("", F.lit(1), F.lit(2), F.lit("x"))) == "e06eba88485a4a6a"
    null = F.lit(None).cast("int")
    assert value(spark, X.note_length_bin(null, True)) == "ge_1500" and value(spark, X.note_length_bin(null)) == "unknown"
    assert value(spark, X.density_bin(null, True)) == "8_plus" and value(spark, X.visit_count_bin(F.lit(7))) == "07-12"
    assert value(spark, X.list_cell(F.lit("['B', 'a ', 'b']"))) == ["a", "b"] and value(spark, X.list_cell(F.lit("junk"))) == []
    assert value(spark, X.fallback_action(F.lit("was discontinued"))) == "start"
    assert value(spark, X.string_id(F.lit(" 12.00 "))) == "12" and value(spark, X.string_id(F.lit("nan"))) is None
    assert value(spark, X.number_id(F.lit("12.0"))) == 12 and value(spark, X.number_id(F.lit("x"))) is None
    assert value(spark, X.grouped_status(F.lit(" Held_or_paused "))) == "not_current"
    assert [value(spark, X.mention_safe(F.lit(t), "drugs")) for t in ("ct", "abc", "a1c", "pain", "x-ray", "")] == [True, False, True, False, True, False]


def test_quotas_and_checks(spark):
    got = R.quotas({"a": 50, "b": 30, "c": 1}, 10)
    assert sum(got.values()) == 10 and got["c"] == 1
    with pytest.raises(ValueError):
        R.quotas({"a": 1, "b": 1, "c": 1}, 2)
    with pytest.raises(ValueError):
        R.require_columns(spark.range(1), ["x"])
    assert R.resolve_column(spark.range(1), ["nope", "ID"]) == "id"


def test_alignment_rules(spark):
    seeds = spark.createDataFrame([(1, "u", 1, 1, "A"), (2, "u", 1, 1, "a"), (3, "v", 2, 5, "B"), (4, "w", 2, 5, "b"), (5, "x", 3, 1, "c")], "ord long, unit_id string, note_id long, span_id long, raw string")
    truth = spark.createDataFrame([(1, "u", 9, 9, "z"), (2, "", 2, 5, "b "), (3, "", 2, 7, "B"), (4, "", 3, 9, "c"), (5, "", 8, 1, "q")], "truth_id long, unit_id string, note_id long, span_id long, raw string")
    got = {r["truth_id"]: (r["seed_ord"], r["join_method"]) for r in R.outer_alignment(truth, seeds).where("truth_id is not null").collect()}
    assert got == {1: (2, "adjudication_unit_id"), 2: (3, "note_span_mention_multi"), 3: (3, "note_mention_multi"), 4: (5, "note_mention"), 5: (None, "unmatched_truth_row")}
    assert {r["seed_ord"] for r in R.outer_alignment(truth, seeds).where("alignment_status = 'false_positive'").collect()} == {1, 4}
