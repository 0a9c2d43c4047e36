"""Report tables, resolved lists, code maps and discovery on small tables, odd rows among them."""

import collections
import math
import random
import zipfile

from pyspark.sql import functions as F

from noteloom.functions import spans as S
from noteloom.operators import relational as R
from noteloom.operators import reports as P
from noteloom.plans import roles
from noteloom.sources import discovery as D
from noteloom.sources import sinks as K
from noteloom.sources import vocabularies as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_long_texts_keep_their_offsets(spark):
    n = 1500  # more than one piece of the arrays
    t = spark.createDataFrame([("ab. the x\n" * n,), ("",), (None,)], "t string")
    got = t.select(S.matches(F.col("t"), S.phrase_pattern(["the", "ab"])).alias("m"), S.sentences(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in got[0]["m"]] == [x for i in range(n) for x in ((10 * i, 10 * i + 2, "ab"), (10 * i + 4, 10 * i + 7, "the"))]
    assert [tuple(x) for x in got[0]["s"]] == [x for i in range(n) for x in ((10 * i, 10 * i + 4), (10 * i + 4, 10 * i + 10))]
    assert got[1]["m"] == [] and [tuple(x) for x in got[1]["s"]] == [(0, 0)]
    assert got[2]["m"] is None and got[2]["s"] is None


def test_leftmost_longest(spark):
    found = [(3 * i, 3 * i + 4, i, "a", "m") for i in range(700)] + [(0, 2, 0, "b", "short")]
    t = spark.createDataFrame([(found,)], "m array<struct<begin:int,end:int,ord:int,category:string,match:string>>")
    got = t.select(S.leftmost_longest(F.col("m")).alias("k")).first()["k"]
    assert [(x["begin"], x["category"]) for x in got] == [(6 * i, "a") for i in range(350)]


def test_descriptions(spark):
    codes = spark.createDataFrame([(1, "A10.1  First Thing "), (2, "A10.1 Last Thing"), (3, "no code"), (4, ""), (5, None)], "ord int, value string")
    v = spark.createDataFrame([("a10.1 x",), ("A101",), (" Other.  Words",), ("",), (None,)], "v string")
    assert rows(P.describe(v, "v", P.code_map(codes), P.condition_tries()).select("v", "description")) == sorted([("a10.1 x", "last thing"), ("A101", "last thing"), (" Other.  Words", "other.  words"), ("", ""), (None, "")], key=str)
    pcs = spark.createDataFrame([(1, "00002 0016070 1 Bypass short   Bypass Long Title"), (2, "bad")], "ord int, value string")
    p = spark.createDataFrame([("x, 0016070.",), ("0016070",), ("0O16070",), (None,)], "v string")
    assert rows(P.describe(p, "v", P.procedure_map(pcs), P.procedure_tries()).select("description")) == [("",), ("0o16070",), ("bypass long title",), ("bypass long title",)]
    assert P.describe(v.limit(0), "v", P.code_map(codes.limit(0)), P.condition_tries()).count() == 0


def test_resolve_lists(spark):
    note = spark.createDataFrame([(1, "asprin"), (1, "asprin"), (1, "statin"), (2, "asprin"), (3, ""), (3, None), (1, "qqqq")], "visit_id int, term string")
    ehr = spark.createDataFrame([(1, "aspirin"), (1, "statin"), (1, ""), (3, "aspirin")], "visit_id int, term string")
    got = {(r["visit_id"], r["term"]): (r["stage"], r["linked_to"], r["accepted"], r["mapped"]) for r in P.resolve_lists(note, ehr, 0.2).collect()}
    assert got == {
        (1, "statin"): ("path_a", "statin", True, "statin"), (1, "asprin"): ("path_b_embedding_cpu", "aspirin", True, "aspirin"),
        (1, "qqqq"): ("path_b_embedding_cpu", "", False, "qqqq"), (2, "asprin"): ("path_a_unresolved", "", False, "asprin"),
    }


def test_groups_are_fitted_by_themselves(spark):
    c = spark.createDataFrame([(1, "aspirin"), (1, "statin"), (2, "aspirin")], "visit_id int, label string")
    m = spark.createDataFrame([(1, "asprin"), (2, "asprin")], "visit_id int, mention string")
    got = {(r["visit_id"], r["label"]): r["score"] for r in R.tfidf_scores(m, c, ("visit_id",)).collect()}
    for v in (1, 2):
        for r in R.tfidf_scores(m.where(F.col("visit_id") == v).drop("visit_id"), c.where(F.col("visit_id") == v).drop("visit_id")).collect():
            assert abs(got.pop((v, r["label"])) - r["score"]) < 1e-12
    assert not got


def test_normalization_detail(spark, sf):
    mentions = spark.createDataFrame([(1, "Known Drug", "known drug", "active_current"), (2, "brandx", "known drug", "active_current"), (3, "zzzz qqqq", "known drug", "active_current"), (4, None, "known drug", None)], "mention_id long, raw string, gold string, status string")
    aliases = spark.createDataFrame([("brandx", "known drug", True, 1)], "alias_raw string, canonical string, include boolean, ord int")
    vocab = spark.createDataFrame([("known drug", [])], "canonical string, synonyms array<string>")
    got = {r["mention_id"]: r for r in P.normalization_detail(mentions, aliases, vocab).collect()}
    assert len(got) == 4
    assert (got[1]["baseline_correct"], got[1]["path_a_correct"], got[1]["path_b_correct"]) == (True, True, True)
    assert got[2]["path_a_correct"] and got[2]["path_b_correct"]
    assert not any(got[i][c] for i in (3, 4) for c in ("baseline_correct", "path_a_correct", "path_b_correct"))
    assert got[3]["error_bucket"] == "pathb_abstained"  # candidates without a common gram count as candidates
    lists = P.resolve_canonical(spark.createDataFrame([(1, "brandx"), (1, "Known Drug"), (2, "zzzz qqqq"), (3, None)], "visit_id int, term string"), aliases, vocab)
    assert rows(lists) == [(1, ["known drug"]), (2, ["zzzz qqqq"])]


def test_tables_of_nothing(spark, sf):
    d = roles.role(spark, sf, "SELECT event_id AS id, event_type AS raw, true AS accepted, 0.5 AS score, 0.5 AS confidence, event_id AS row FROM {events}").limit(0)
    assert rows(P.guardrails(d)) == [(0, 0.0, 0.0, 0.0)]
    assert rows(P.shares(d, "raw")) == [] and rows(P.link_audit(d, True)) == [] and rows(P.top_counts(d, "raw")) == []
    steps = d.select("accepted", *[F.col("accepted").alias(f"{n}_correct") for n in ("baseline", "path_a", "path_b")])
    assert rows(P.accuracy_steps(steps)) == [(0, "baseline", None, None, None, None), (1, "path_a", None, None, None, None), (2, "path_b", None, None, 0.0, 0.0)]


def test_lexicons_and_layout(spark, tmp_path):
    (tmp_path / "candidate_treatment_actions__stop.csv").write_text("term\nStop it\nquit\n")
    (tmp_path / "ehr_entities__drugs.txt").write_text("Aspirin\n")
    (tmp_path / "other.csv").write_text("term\nx\n")
    got = D.lexicons(spark, str(tmp_path))
    assert got["actions"] == {"start": ("start",), "stop": ("stop it", "quit"), "hold": ("hold",), "dose_change": ("dose reduced",)}
    assert got["entities"] == {"drugs": ("aspirin",)} and got["context"] == {"regimen": ("regimen",)}
    for p in ("ICD10 CM 2026/deep/icd10cm_codes_x.txt", "icd-pcs-cm/icd10pcs_order_1.txt", "NCIt/Thesaurus.txt", "sub/SDTM Terminology.xlsx", "sub/CTCAE.xlsx", "CTCAE v5.csv", "Loinc_2/LoincTableCore/LoincTableCore.csv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = {k: v.removeprefix(f"{tmp_path}/") for k, v in D.raw_vocabularies(spark, str(tmp_path)).items()}
    assert found == {"icd10cm": "ICD10 CM 2026/deep/icd10cm_codes_x.txt", "icd10pcs": "icd-pcs-cm/icd10pcs_order_1.txt", "ncit": "NCIt/Thesaurus.txt", "sdtm": "sub/SDTM Terminology.xlsx", "ctcae": "CTCAE v5.csv", "loinc": "Loinc_2/LoincTableCore/LoincTableCore.csv"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/One.TXT", "first")
        z.writestr("two.bin", "second")
    assert [(r["member"], bytes(r["content"])) for r in D.zip_members(spark, f"{tmp_path}/a.zip", r"\.txt$").collect()] == [("in/One.TXT", b"first")]


def test_reason_lists(spark, tmp_path):
    line = lambda names, systems: "\t".join(["C1", "x", "y", names, "d", "e", "f", "g", systems])
    (tmp_path / "t.txt").write_text("\n".join([line("Financial burden|Withdrawal by Subject|a", "Reason for Non-Completion"), line("Drug held, hold", "Reason for Treatment Interruption"), line("Any words", "Dose Limiting Toxicity"), line("cost", "other"), "short\tline"]))
    got = rows(V.thesaurus_reasons(spark, str(tmp_path / "t.txt")))
    # "reason for treatment interruption" names "reason for treatment" too.
    assert got == sorted([("reasons", "cost", "financial burden"), ("reasons", "patient_preference", "withdrawal by subject"), ("actions", "stop", "withdrawal by subject"), ("actions", "hold", "drug held, hold"), ("actions", "dose_change", "any words")], key=str)
    (tmp_path / "c.csv").write_text("Code,CDISC Submission Value\n1,COMPLETED\n2,Dose Reduced\n3,\n")
    assert rows(V.codelist_reasons(spark, str(tmp_path / "c.csv"))) == [("actions", "dose_change", "dose reduced"), ("reasons", "completion", "completed")]
    (tmp_path / "e.csv").write_text("Code,CTCAE Term,Other\n10001,Nausea,zz\n10002, Fatigue ,\n")
    assert rows(V.adverse_events(spark, str(tmp_path / "e.csv"))) == [("Fatigue",), ("Nausea",)]
    (tmp_path / "f.csv").write_text("Code,Other\nabcd,z\n")
    assert rows(V.adverse_events(spark, str(tmp_path / "f.csv"))) == [("abcd",)]


def test_strata_and_targets(spark):
    d = spark.createDataFrame([(i, None if i % 10 == 0 else "a") for i in range(100)], "id int, s string")
    assert rows(R.stratified_sample(d, "s", "id", 20, "x").groupBy("s").count()) == [("a", 18), (None, 2)]
    t = spark.createDataFrame([("take A+B now, a+b.", " a+b "), ("x", ""), ("x", None), (r"a\Eb", r"a\Eb")], "t string, d string")
    got = [r["m"] for r in t.select(S.matches(F.col("t"), S.target_pattern(F.col("d"))).alias("m")).collect()]
    assert [m and [tuple(x) for x in m] for m in got] == [[(5, 8, "A+B"), (14, 17, "a+b")], None, None, [(0, 4, r"a\Eb")]]


def test_lines(spark, tmp_path):
    K.write_lines(spark.createDataFrame([("a", 0.1, 1.0), ("a", 0.2, None), ("b<", 0.5, 2.0)], "s string, x double, y double"), "s", "x", "y", "T & t", f"{tmp_path}/l.svg")
    svg = (tmp_path / "l.svg").read_text()
    assert svg.count("<polyline") == 2 and "b&lt;" in svg and "T &amp; t" in svg
    assert "<svg" in K.line_svg("none", {})


def test_resolve_lists_deals_terms_once(spark):
    """Random visits, one of them wide, against the TF-IDF scores by definition; grams are not shuffled."""
    rng = random.Random(3)
    term = lambda: "".join(rng.choice("abc é") for _ in range(rng.randrange(1, 7)))
    visit = lambda: rng.choice([None, 1, 2, 3, 4, 900, 900, 900, 900])
    note = [(visit(), rng.choice([term(), term(), "", None])) for _ in range(500)] + [(7, "abc"), (7, "abc"), (8, "zzzz")]
    ehr = [(visit(), rng.choice([term(), term(), "", None])) for _ in range(400)] + [(8, "abc")]
    grams = lambda t: collections.Counter(f" {t} "[i : i + n] for n in (3, 4) for i in range(len(t) + 3 - n))
    want = []
    for v, t in {r for r in note if r[1]}:
        labels = sorted({u for w, u in ehr if u and w == v and v is not None})
        df = collections.Counter(g for u in labels for g in grams(u))
        df = {g: sum(g in grams(u) for u in labels) for g in df}
        vec = lambda u: {g: n * (math.log((1 + len(labels)) / (1 + df[g])) + 1 if g in df else 1) for g, n in grams(u).items()}  # noqa: B023, E731
        size = lambda x: math.sqrt(sum(y * y for y in x.values()))
        m = vec(t)
        best = min(((-round(sum(x * m.get(g, 0) for g, x in vec(u).items()) / size(m) / size(vec(u)), 9), u) for u in labels if any(g in m for g in grams(u))), default=(0.0, ""))
        stage, best = ("path_a", (-1.0, t)) if t in labels else ("path_b_embedding_cpu" if labels else "path_a_unresolved", best)
        ok = best[1] != "" and -best[0] >= 0.3
        want.append((v, t, stage, best[1], ok, best[1] if ok else t))
    assert len({u for w, u in ehr if u and w == 900}) > P.WIDE
    t, e = (spark.createDataFrame(r, "visit_id int, term string") for r in (note, ehr))
    got = P.resolve_lists(t, e, 0.3)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(rows(got.drop("score")), key=str) == sorted(want, key=str)
    assert rows(P.resolve_lists(t, e.limit(0), 0.3).select("stage").distinct()) == [("path_a_unresolved",)]
    assert rows(P.resolve_lists(t.limit(0), e, 0.3)) == []
