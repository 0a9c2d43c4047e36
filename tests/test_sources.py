"""Readers, vocabulary scans and sinks on small files."""

import json

import pytest

from noteloom.sources import readers as S
from noteloom.sources import sinks as K
from noteloom.sources import vocabularies as V


def terms(df):
    return sorted(r["term"] for r in df.collect())


def put(path, text):
    path.write_text(text)
    return str(path)


def test_chunks_and_any(spark, tmp_path):
    for i in (10, 2, 1):
        spark.range(i).write.parquet(f"{tmp_path}/p/chunk_{i}.parquet")
    paths = S.chunk_paths(spark, f"{tmp_path}/p", "chunk_")
    assert [p.rsplit("_", 1)[1] for p in paths] == ["1.parquet", "2.parquet", "10.parquet"]
    assert S.read_chunks(spark, paths).count() == 13
    assert S.read_any(spark, f"{tmp_path}/p").count() == 13
    with pytest.raises(FileNotFoundError):
        S.read_chunks(spark, [])
    put(tmp_path / "a.csv", 'x,y\n1,"two\nlines ""q"""\n2,\n')
    assert [tuple(r) for r in S.read_any(spark, f"{tmp_path}/a.csv").collect()] == [("1", 'two\nlines "q"'), ("2", "")]


def test_configs_and_lists(spark, tmp_path):
    assert S.read_config(spark, f"{tmp_path}/none.json") == {}
    assert S.read_config(spark, put(tmp_path / "bad.json", "[1")) == {}
    assert S.read_config(spark, put(tmp_path / "ok.json", '{"a": 1}')) == {"a": 1}
    assert [r["term"] for r in S.term_list(spark, put(tmp_path / "t.txt", "Beta\n\n alpha  x \nbeta\n")).orderBy("ord").collect()] == ["beta", "alpha x"]
    assert terms(S.term_list(spark, put(tmp_path / "t.csv", "n,Term\n1,Aa\n2,aa\n3,b\n"))) == ["aa", "b"]
    assert terms(S.term_list(spark, put(tmp_path / "u.csv", "first\nsecond\n"))) == ["first", "second"]
    got = S.counted_terms(spark, put(tmp_path / "c.csv", "patha_term,mention_count\nx,3\ny,bad\n"), 2)
    assert [tuple(r) for r in got.collect()] == [("x", 3)]


def test_medications(spark, tmp_path):
    lines = [{"note_id": "1", "medications": ["Old"]}, {"note_id": " 1 ", "medications": ["Taxol 5 mg", "taxol", "", "Zofran"]}, {"note_id": "", "medications": ["x"]}, {"note_id": "2"}]
    p = put(tmp_path / "m.jsonl", "\n".join(map(json.dumps, lines)))
    assert sorted((r["note_id"], r["pos"], r["raw"], r["norm"]) for r in S.medications(spark, p).collect()) == [("1", 0, "Taxol 5 mg", "taxol"), ("1", 3, "Zofran", "zofran")]


def test_aliases_exclusions_vocabulary(spark, tmp_path):
    rows = S.aliases(spark, put(tmp_path / "a.csv", "alias_raw,canonical,include\nTaxol,paclitaxel,1\nx,,1\nTx,y,no\n")).orderBy("ord").collect()
    assert [(r["alias_raw"], r["canonical"], r["include"]) for r in rows] == [("Taxol", "paclitaxel", True), ("Tx", "y", False)]
    assert S.aliases(spark, put(tmp_path / "a.json", '{"aliases": {"b": "c"}}')).first()["canonical"] == "c"
    with pytest.raises(FileNotFoundError):
        S.aliases(spark, f"{tmp_path}/no.csv")
    assert S.aliases(spark, f"{tmp_path}/no.csv", True).count() == 0
    assert terms(S.exclusions(spark, put(tmp_path / "e.csv", "alias\nTx\nSaline\n"))) == ["saline"]
    for name, text in (("v.csv", "canonical,synonyms\na,b|c; d\n"), ("v.json", '{"a": "b|c,d"}'), ("w.json", '[{"canonical": "a", "synonyms": ["b", "c", "d"]}]')):
        assert [tuple(r) for r in S.vocabulary(spark, put(tmp_path / name, text)).collect()] == [("a", ["b", "c", "d"])]


def test_vocabulary_scans(spark, tmp_path):
    row = lambda sab, tty, s: "|".join(["0"] * 11 + [sab, tty, "c", s, "n"])
    assert terms(V.rxnorm(spark, put(tmp_path / "r.rrf", "\n".join([row("RXNORM", "IN", "Taxol"), row("RXNORM", "DF", "Pill"), row("MSH", "IN", "Other"), "short|x"])))) == ["taxol"]
    assert terms(V.icd10cm(spark, put(tmp_path / "i.txt", "Codes and more\nA00.0   Cholera due to X\n\nlower x\n"))) == ["cholera due to x"]
    assert terms(V.icd10pcs(spark, put(tmp_path / "p.txt", "00002 0016070 1 Bypass Cereb   Bypass Cerebral Ventricle\nonly one\n"))) == ["bypass cerebral ventricle"]
    assert terms(V.loinc(spark, put(tmp_path / "l.csv", "LONG_COMMON_NAME,SHORTNAME,DisplayName\nGlucose in Blood,Gluc,Glucose\n"))) == ["glucose", "glucose in blood"]
    got = V.thesaurus(spark, put(tmp_path / "n.tsv", "C1\tx\ty\tABC Regimen|Disease Progression|ok\tz\nC2\tx\n"))
    assert sorted(map(tuple, got.collect())) == [("context", "abc regimen"), ("progression", "disease progression")]
    lex = V.lexicon(spark, {"drugs": V.loinc(spark, f"{tmp_path}/l.csv"), "none": spark.createDataFrame([], "term string")}, {"drugs": ["builtin drug"], "none": ["Kept  One"]})
    assert sorted(map(tuple, lex.collect())) == [("drugs", "raw", "glucose"), ("drugs", "raw", "glucose in blood"), ("none", "builtin", "kept one")]


def test_corpus_and_sinks(spark, tmp_path):
    (tmp_path / "c/d").mkdir(parents=True)
    put(tmp_path / "c/d/x.txt", "One thing here. And another!\nshort\n")
    assert sorted(r[0] for r in S.corpus_sentences(spark, f"{tmp_path}/c").collect()) == ["And another!", "One thing here."]
    df = spark.createDataFrame([("a|b", 1.5, None), ('q,"', None, 2)], "name string, v double, n int").orderBy("name")
    K.write_report(df, f"{tmp_path}/report")
    assert (tmp_path / "report.csv").read_text() == 'name,v,n\na|b,1.500000,\n"q,""",,2\n'
    assert "| a\\|b | 1.500000 |  |" in (tmp_path / "report.md").read_text()
    K.write_report(df, f"{tmp_path}/report")  # again, over itself
    with pytest.raises(ValueError):
        K.write_report(spark.range(K.REPORT_ROWS + 1), f"{tmp_path}/much")
    K.write_jsonl(df, f"{tmp_path}/j")
    assert spark.read.schema(df.schema).json(f"{tmp_path}/j").count() == 2
    K.write_lexicon(spark.createDataFrame([("b",), ("a",), ("a",), ("",)], "term string"), f"{tmp_path}/lex")
    assert [r[0] for r in spark.read.option("header", True).csv(f"{tmp_path}/lex").collect()] == ["a", "b"]
    K.write_summary(spark, f"{tmp_path}/s.json", {"n": 3})
    assert json.loads((tmp_path / "s.json").read_text()).keys() == {"n", "timestamp_utc"}
    put(tmp_path / "b.csv", "k\n1\n")
    assert K.snapshot(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], f"{tmp_path}/snap", "base").endswith("b.csv")
    assert spark.read.parquet(f"{tmp_path}/snap").first()["method_label"] == "base"
    K.write_bars(df.na.fill(0), "name", "v", "A & B", f"{tmp_path}/f.svg")
    assert "A &amp; B" in (tmp_path / "f.svg").read_text()
