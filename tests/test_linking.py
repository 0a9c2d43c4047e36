"""The scored linker and the greedy assignment against plain Python."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.operators import linking as L

LABELS = {"sodium chloride": ["saline", "normal saline"], "potassium chloride": ["kcl"], "paclitaxel": ["taxol"], "docetaxel": [], "trastuzumab and hyaluronidase": []}
ALIASES = [("taxotere", "docetaxel", True, 1), ("tax", "paclitaxel", False, 2)]
ABBR = [("nacl", "sodium chloride")]


def _tables(spark):
    a = spark.createDataFrame(ALIASES, "alias_raw string, canonical string, include boolean, ord int")
    v = spark.createDataFrame(list(LABELS.items()), "canonical string, synonyms array<string>")
    return a, v, spark.createDataFrame(ABBR, "abbr string, expanded string")


def _brute(m):
    """Scores of all labels by the features' definitions, best first."""
    syn = {k: {k, *v} | {a for a, c, ok, _ in ALIASES if ok and c == k} for k, v in LABELS.items()}
    own = {k: {a for a, c, ok, _ in ALIASES if ok and c == k} for k in LABELS}
    expanded, out = dict(ABBR).get(m, ""), []
    for k in LABELS:
        a, b = [t for t in m.split() if t not in X.NOISE_TOKENS], k.split()
        both = set(a) & set(b)
        f = {
            "exact_norm_eq": m in syn[k], "exact_token_set_eq": bool(a) and set(a) == set(b), "token_jaccard": len(both) / len(set(a) | set(b)), "containment_ratio": len(both) / max(len(set(a)), 1),
            "edit_similarity": SequenceMatcher(None, m, k).ratio(), "longest_token_overlap": max(map(len, both)) / max(map(len, a)) if both else 0, "first_informative_token_match": bool(a) and a[0] == b[0],
            "alias_hit": m in own[k], "brand_generic_relation": m in own[k] and m != k, "ingredient_overlap": bool(both & {t for t in b if t not in ("and", "with", "plus")}), "abbreviation_expansion_hit": expanded in syn[k],
        }
        out.append((-round(sum(w * f[n] for n, w in L.WEIGHTS.items()) / sum(L.WEIGHTS.values()), 6), k))
    return [(k, -s) for s, k in sorted(out)]


def test_link_mentions(spark):
    a, v, abbr = _tables(spark)
    raws = ["Taxol 175 mg", "taxotere", "", None, "sodium phosphate", "paclitaxl", "nacl", "chloride", "trastuzumab", "zzz qqq"]
    m = spark.createDataFrame([(i, r, "active_current") for i, r in enumerate(raws)] + [(50, "sodium phosphate", "unclear")], "mention_id int, raw string, status string")
    got = {r["mention_id"]: r for r in L.link_mentions(m, a, v, abbr).collect()}
    assert len(got) == 11
    assert (got[0]["prediction"], got[0]["stage"], got[0]["score"]) == ("paclitaxel", "path_a_exact_vocab", 1.0)
    assert (got[1]["prediction"], got[1]["accepted"]) == ("docetaxel", True)
    for i in (2, 3):
        assert (got[i]["reasons"], got[i]["accepted"], got[i]["stage"]) == (["empty_after_normalization"], False, "path_a_unresolved")
    for i in range(4, 10):
        want = _brute(got[i]["term"])
        assert [(x["label"], round(x["score"], 5)) for x in got[i]["top_k"]] == [(k, round(s, 5)) for k, s in want], raws[i]
        assert not got[i]["accepted"] and got[i]["prediction"] == ""
        assert abs(got[i]["margin"] - (want[0][1] - want[1][1])) < 1e-6
    assert "ambiguous_short_term" in got[5]["reasons"] and "combo_single_agent_mismatch" in got[8]["reasons"]
    assert got[50]["reasons"] == [*got[4]["reasons"], "out_of_scope_mention_status"]


def test_calibration_can_accept(spark):
    a, v, abbr = _tables(spark)
    m = spark.createDataFrame([(1, "sodium chloride hypertonic", "")], "mention_id int, raw string, status string")
    low, high = (L.link_mentions(m, a, v, abbr, c).first() for c in (None, {"type": "score_bins", "bins": [{"score_min": 0.4, "score_max": 1, "precision": 0.95}]}))
    assert low["reasons"] == ["confidence_below_target_precision"] or "score_below_min" in low["reasons"]
    assert high["confidence"] == (0.95 if high["score"] >= 0.4 else high["score"])
    assert high["accepted"] == (high["score"] >= 0.45)
    platt = L.link_mentions(m, a, v, abbr, {"type": "platt", "a": 0, "b": 100}).first()
    assert platt["confidence"] == 1.0


def test_empty_universe_falls_back(spark):
    a, v, _ = (t.limit(0) for t in _tables(spark))
    assert sorted(r["label"] for r in L.universe(a, v).collect()) == sorted(L.FALLBACK_LABELS)


def test_assign_greedy(spark):
    t = spark.createDataFrame([("n1", 0, "taxol", "paclitaxel"), ("n1", 1, "zofran", "ondansetron"), ("n1", 2, "aspirin", "aspirin"), ("n2", 0, "iron", "iron"), ("n3", 0, "", "")], "note_id string, pos int, norm string, label string")
    s = spark.createDataFrame([("n1", 1, "a", "other", "other", []), ("n1", 2, "b", "taxol", "paclitaxel", ["taxol"]), ("n4", 1, "c", "x", "x", None)], "note_id string, ord long, unit_id string, norm string, canonical string, drugs array<string>")
    got = {(r["note_id"], r["pos"]): (r["unit_id"], r["matched"]) for r in L.assign_greedy(t, s).collect()}
    assert got[("n1", 0)] == ("b", True)
    assert got[("n1", 1)] == ("a", True)  # no signal: the first that is free
    assert not got[("n1", 2)][1] and got[("n1", 2)][0].startswith("adj_")
    assert not got[("n2", 0)][1] and len(got) == 4


def test_greedy_assignment_reads_every_line(spark, sf):
    from noteloom.plans import linking

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = linking.QUERIES["greedy_assignment"](spark, sf).groupBy("pos").agg(F.count("*").alias("n"), F.count_if("matched").alias("m")).collect()
    assert {r["pos"]: r["n"] for r in got} == {r["l_linenumber"]: r["count"] for r in lines.groupBy("l_linenumber").count().collect()}
    assert sum(r["m"] for r in got if r["pos"] > 4) > 0


def test_assign_greedy_by_partitions(spark):
    """Random notes, blank and unknown ids and one long note against the plain order of choice, without a Python group for each note."""
    rng = random.Random(7)
    words = ["iron", "zinc", "taxol", "kcl", "aspirin", "iron zinc", ""]
    note = lambda: rng.choice([None, "", *map(str, range(40))])
    truth = [(note(), rng.randrange(5), rng.choice(words), rng.choice(words[:-1])) for _ in range(400)] + [("long", i, f"{words[i % 6]} {i // 150}", "x") for i in range(700)]
    seeds = [(n := note(), i, rng.choice([f"u{n}_{i % 7}", f"u{i}"]), rng.choice([*words, None]), rng.choice([*words, None]), rng.choice([None, [], rng.sample(words, 2)])) for i in range(400)] + [("long", 1000 + i, f"l{i}", f"{words[i % 6]} {i // 140}", None, None) for i in range(650)]
    want = []
    for n in {r[0] for r in truth}:
        free = [(u, m or "", c or "", {d for d in g or () if d}) for k, _, u, m, c, g in sorted((s for s in seeds if s[0] == n), key=lambda s: s[1])]
        for _, pos, norm, label in sorted((t for t in truth if t[0] == n and t[2]), key=lambda t: t[1:]):
            points = [L._points(norm, label, x[1:]) for x in free]
            best = max(range(len(free)), key=lambda i: (points[i], -i), default=None)
            unit = free[0 if points[best] < 1 else best][0] if free else None
            free = [x for x in free if x[0] != unit]
            want.append((n, pos, norm, label, unit))
    t = spark.createDataFrame(truth, "note_id string, pos int, norm string, label string")
    s = spark.createDataFrame(seeds, "note_id string, ord long, unit_id string, norm string, canonical string, drugs array<string>")
    df = L.assign_greedy(t, s)
    assert "FlatMapCoGroups" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(r["note_id"], r["pos"], r["norm"], r["label"], r["unit_id"] if r["matched"] else None) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
