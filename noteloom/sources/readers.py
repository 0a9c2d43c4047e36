"""Scans: tables by glob, prefix or suffix, CSV as strings, JSON lines, term lists, aliases, exclusions, vocabularies.

Files are opened by Spark's readers alone, so any store that Spark reaches will do. Where the order of rows decides,
`ord` holds file, block and place in it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.operators import relational as R

ALIAS_COLUMNS = ("alias_raw", "canonical", "alias_type", "confidence", "source", "notes", "include", "ord")


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's entries, sorted; none if there is no such folder."""
    p, fs = hadoop_path(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def in_order() -> Column:
    """Place of a row in what was read: file, then block, then row."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))


def chunk_paths(spark: SparkSession, folder: str, prefix: str = "", names: list[str] | None = None) -> list[str]:
    """The named chunks, else Parquet entries that start with the prefix, by the number their name ends in."""
    if names:
        return [f"{folder.rstrip('/')}/{n}" for n in names]
    tail = lambda p: re.search(r"(\d+)(?:\.parquet)?$", p)
    own = [p for p in listed(spark, folder) if p.rsplit("/", 1)[-1].startswith(prefix) and p.endswith(".parquet")]
    return sorted(own, key=lambda p: (tail(p) is None, int(tail(p)[1]) if tail(p) else 0, p))


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        raise FileNotFoundError("no chunks")
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header: quoted line ends and doubled quotes allowed; all strings, null as empty, unless a schema is given."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return r.schema(schema).csv(path) if schema else r.csv(path).na.fill("")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet file; of a folder its Parquet files, or its CSV files if it has none."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    inside = listed(spark, path)
    for suffix, read in ((".parquet", lambda p: spark.read.parquet(*p)), (".csv", lambda p: read_csv(spark, p))):
        if own := [p for p in inside if p.endswith(suffix)]:
            return read(own)
    raise FileNotFoundError(f"neither Parquet nor CSV at {path}")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object of settings; empty if the file is missing or holds anything else."""
    if not exists(spark, path):
        return {}
    try:
        got = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def medications(spark: SparkSession, path: str) -> DataFrame:
    """(note_id, pos, raw, norm) from JSON lines: a note's last line counts, of terms with one norm the first."""
    lines = spark.read.schema("note_id string, medications array<string>").json(path)
    lines = lines.select(X.strip(F.col("note_id")).alias("note_id"), "medications", in_order().alias("ord")).where("note_id <> '' and medications is not null")
    last = lines.groupBy("note_id").agg(F.max_by("medications", "ord").alias("m"))
    terms = last.select("note_id", F.posexplode("m").alias("pos", "raw")).select("note_id", "pos", X.strip(F.col("raw")).alias("raw"))
    terms = terms.withColumn("norm", X.drug_norm(F.col("raw"))).where("norm <> ''")
    return terms.groupBy("note_id", "norm").agg(F.min("pos").alias("pos"), F.min_by("raw", "pos").alias("raw")).select("note_id", "pos", "raw", "norm")


def aliases(spark: SparkSession, path: str, allow_missing: bool = False) -> DataFrame:
    """ALIAS_COLUMNS from CSV, or from JSON that maps aliases to labels or holds such a map or list under `aliases`."""
    schema = "alias_raw string, canonical string, alias_type string, confidence string, source string, notes string, include boolean"
    if not exists(spark, path):
        if not allow_missing:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema).withColumn("ord", F.lit(0).cast("long"))
    if path.endswith(".json"):
        got = read_config(spark, path)
        got = got.get("aliases", got)
        pairs = got.items() if isinstance(got, dict) else [(x.get("alias") or x.get("alias_raw"), x.get("canonical")) for x in got]
        rows = [(a, c, "", "", "", "", True, i) for i, (a, c) in enumerate(pairs) if isinstance(a, str) and isinstance(c, str) and a.strip() and c.strip()]
        return spark.createDataFrame(rows, schema + ", ord long")
    df = read_csv(spark, path).select("*", in_order().alias("ord"))
    pick = lambda *names: F.col(c) if (c := R.resolve_column(df, list(names))) else F.lit("")
    include = ~X.clean(pick("include")).isin("0", "false", "no", "n")
    out = df.select(X.strip(pick("alias_raw", "alias")).alias("alias_raw"), X.strip(pick("canonical", "canonical_label")).alias("canonical"), *[pick(c).alias(c) for c in ALIAS_COLUMNS[2:6]], include.alias("include"), "ord")
    return out.where("alias_raw <> '' and canonical <> ''")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(term): distinct normalized terms; what normalizes to nothing excludes nothing."""
    df = read_csv(spark, path)
    col = R.resolve_column(df, ["term", "alias", "alias_raw", "alias_normalized"])
    if not col:
        return spark.createDataFrame([], "term string")
    return df.select(X.drug_norm(F.col(col)).alias("term")).where("term <> ''").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, synonyms): JSON map or list, or CSV whose synonyms are separated by | or ;."""
    if path.endswith(".json"):
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        got = json.loads(text)
        parts = lambda v: [str(x) for x in v] if isinstance(v, list) else [x.strip() for x in re.split(r"[|;,]", str(v or "")) if x.strip()]
        if isinstance(got, dict):
            rows = [(k, parts(v)) for k, v in got.items()]
        else:
            rows = [(x, []) if isinstance(x, str) else (x.get("canonical") or x.get("canonical_label") or x.get("label") or "", parts(x.get("synonyms"))) for x in got]
        return spark.createDataFrame([r for r in rows if r[0].strip()], "canonical string, synonyms array<string>")
    df = read_csv(spark, path)
    label = R.resolve_column(df, ["canonical", "canonical_label", "label", "term"])
    syn = R.resolve_column(df, ["synonyms", "synonym"])
    split = F.filter(F.transform(F.split(F.col(syn), "[|;]"), X.strip), lambda s: s != "") if syn else F.array().cast("array<string>")
    return df.select(X.strip(F.col(label)).alias("canonical"), split.alias("synonyms")).where("canonical <> ''")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, ord): lines of a text file, or a CSV's `term` column, else its first column, header line included."""
    if path.endswith(".txt"):
        raw = spark.read.text(path).select(F.col("value").alias("t"), in_order().alias("ord"))
    else:
        df = spark.read.option("header", True).csv(path)
        if col := R.resolve_column(df, ["term"]):
            raw = df.select(F.col(col).alias("t"), in_order().alias("ord"))
        else:
            bare = spark.read.csv(path)
            raw = bare.select(F.col(bare.columns[0]).alias("t"), in_order().alias("ord"))
    return raw.select(X.surface(F.col("t")).alias("term"), "ord").where("term <> ''").groupBy("term").agg(F.min("ord").alias("ord"))


def counted_terms(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(term, n) of a CSV with a count column, those of at least `least`; a count that is no number is 0."""
    df = read_csv(spark, path)
    term = R.resolve_column(df, ["term", "patha_term", "mention"]) or df.columns[0]
    n = R.resolve_column(df, ["mention_count", "count", "n", "frequency"])
    count = F.coalesce(F.col(n).try_cast("double").cast("long"), F.lit(0)) if n else F.lit(1).cast("long")
    return df.select(X.surface(F.col(term)).alias("term"), count.alias("n")).where("term <> ''").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def notes_of(notes: DataFrame, ids: DataFrame, order: list[Column]) -> DataFrame:
    """The notes of the given note_ids, the last by the order of each."""
    return R.keep_first(notes.join(ids.select("note_id").distinct(), "note_id", "left_semi"), ["note_id"], *order)


def corpus_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(sentence) of all .txt files below a folder: lines of ten characters or more, cut behind sentence ends."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder).select(X.strip(F.col("value")).alias("t")).where("length(t) >= 10")
    return lines.select(F.explode(F.split("t", r"(?U)(?<=[.!?])\s+")).alias("s")).select(X.strip(F.col("s")).alias("sentence")).where("sentence <> ''")
