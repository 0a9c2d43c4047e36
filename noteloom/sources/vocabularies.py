"""Scans of raw public vocabularies into terms, and the lexicon that joins them with built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.sources.readers import read_csv

# Term types and the words that sort thesaurus terms.
RXNORM_TYPES = ("IN", "PIN", "SCD", "SBD", "BN", "MIN")
LOINC_NAMES = ("LONG_COMMON_NAME", "CONSUMER_NAME", "DisplayName")
THESAURUS = {
    "context": ("regimen", "protocol", "chemotherapy", "immunotherapy", "cycle", "combination therapy"),
    "progression": ("progression", "progressive disease", "refractory", "resistant", "failed therapy"),
    "improvement": ("remission", "response", "improved", "stable disease", "partial response", "complete response"),
}
DISCONTINUED, INTERRUPTED, TREATED, DOSED = ("reason for non-completion", "study subject discontinuation"), ("reason for treatment interruption",), ("reason for treatment",), ("dose limiting", "dose modification")
# (kind, label, code systems of which one must be named, words of which one must be in the term; none: any term)
THESAURUS_RULES = (
    ("reasons", "cost", DISCONTINUED, ("financial", "cost", "insurance", "afford", "burden", "expense", "financial strain", "financial difficulty")),
    ("reasons", "logistics", DISCONTINUED, ("logistical", "logistics", "availability", "access", "unable to obtain", "pharmacy", "lost to follow", "lost to follow-up", "relocation", "lost")),
    ("reasons", "patient_preference", DISCONTINUED, ("withdrawal of consent", "withdrew", "consent withdrawn", "refused", "declined", "patient preference", "subject withdrawal", "withdrawal by subject", "parent or guardian", "withdrawal", "withdrawn", "non-compliance", "opted out")),
    ("reasons", "completion", DISCONTINUED, ("treatment completed", "completed the study", "completed protocol", "completed as prescribed", "completion", "completed", "finished")),
    ("actions", "stop", DISCONTINUED, ("discontinu", "withdraw", "stop", "cease")),
    ("actions", "hold", INTERRUPTED, ("hold", "pause", "suspend", "interruption", "temporarily")),
    ("actions", "dose_change", INTERRUPTED, ("dose reduc", "dose increas", "dose adjust", "forgot to take", "missed dose", "dose modif")),
    ("actions", "start", TREATED, ("start", "initiate", "begin", "resume", "continue")),
    ("actions", "stop", TREATED, ("stop", "discontinu", "cease", "withdraw")),
    ("actions", "dose_change", DOSED, ()),
)
CODELIST_RULES = (
    ("reasons", "cost", ("financial", "cost", "insurance", "afford", "burden")),
    ("reasons", "logistics", ("logistical", "availability", "access", "pharmacy", "lost to follow")),
    ("reasons", "patient_preference", ("withdrawal", "consent", "refused", "declined", "patient")),
    ("reasons", "completion", ("completed", "completion", "finished")),
    ("actions", "hold", ("hold", "pause", "suspend", "interruption")),
    ("actions", "dose_change", ("dose reduc", "dose increas", "dose adjust", "dose modif")),
)
EVENT_COLUMNS = ("term", "adverse", "name", "meddra", "ae ", "llt", "preferred")
# End of the fixed values.


def _terms(df: DataFrame, c: Column) -> DataFrame:
    return df.select(X.surface(c).alias("term")).where("term <> ''").distinct()


def rxnorm(spark: SparkSession, path: str) -> DataFrame:
    """Drug names of a pipe-delimited concept file: 12th column RXNORM, 13th a wanted type, 15th the name."""
    f = F.split("value", r"\|")
    rows = spark.read.text(path).where(F.size(f) >= 15)
    return _terms(rows.where((f[11] == "RXNORM") & f[12].isin(*RXNORM_TYPES)), f[14])


def icd10cm(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions behind the codes of a two-column text file."""
    line = X.strip(F.col("value"))
    hit = F.regexp_extract(line, r"(?U)^[A-Z0-9.]+\s+(.+)$", 1)
    return _terms(spark.read.text(path).where(~line.startswith("Codes")), hit)


def icd10pcs(spark: SparkSession, path: str) -> DataFrame:
    """Long titles: what comes last behind two or more spaces."""
    parts = F.split(X.strip(F.col("value")), r"(?U)\s{2,}")
    return _terms(spark.read.text(path).where(F.size(parts) >= 2), F.element_at(parts, -1))


def loinc(spark: SparkSession, path: str) -> DataFrame:
    """Names meant for people, of those columns that the table has."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    own = [F.col(c) for c in LOINC_NAMES if c in df.columns]
    return _terms(df.select(F.explode(F.array(*own)).alias("t")), F.col("t")) if own else spark.createDataFrame([], "term string")


def thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, term) of a tab-delimited thesaurus: names and synonyms of the fourth column that hold a bucket's word."""
    f = F.split(X.strip(F.col("value")), "\t")
    names = spark.read.text(path).where(F.size(f) >= 4).select(F.explode(F.split(f[3], r"\|")).alias("t")).select(X.surface(F.col("t")).alias("term")).where("length(term) >= 3")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("term").contains(w))
    buckets = F.array_compact(F.array(*[F.when(has(w), F.lit(b)) for b, w in THESAURUS.items()]))
    return names.select(F.explode(buckets).alias("bucket"), "term").distinct()


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)) if words else F.lit(True)


def thesaurus_reasons(spark: SparkSession, path: str) -> DataFrame:
    """(kind, label, term) of a tab-delimited thesaurus: names and synonyms that a rule takes by the code systems of the ninth column and by words."""
    f = F.split(X.strip(F.col("value")), "\t")
    rows = spark.read.text(path).where(F.size(f) >= 9).select(F.lower(f[8]).alias("systems"), F.explode(F.split(f[3], r"\|")).alias("t"))
    rows = rows.select("systems", X.surface(F.col("t")).alias("term")).where("length(term) >= 2")
    hits = [F.when(_holds(F.col("systems"), gate) & _holds(F.col("term"), words), F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))) for kind, label, gate, words in THESAURUS_RULES]
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("x"), "term").select("x.*", "term").distinct()


def codelist_reasons(spark: SparkSession, path: str) -> DataFrame:
    """(kind, label, term) of a code list exported as CSV: its submission value or term column, else its first one."""
    df = read_csv(spark, path)
    fits = lambda c: "submission value" in c or ("term" in c and "code" not in c) or ("cdisc" in c and "value" in c)
    own = next((c for c in df.columns if fits(c.lower())), df.columns[0])
    terms = _terms(df, F.col(f"`{own}`")).where("length(term) >= 2")
    hits = [F.when(_holds(F.col("term"), words), F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))) for kind, label, words in CODELIST_RULES]
    return terms.select(F.explode(F.array_compact(F.array(*hits))).alias("x"), "term").select("x.*", "term").distinct()


def adverse_events(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an adverse event table exported as CSV: all columns that look like names, the first one if none has any."""
    df = read_csv(spark, path)
    like = [c for c in df.columns if any(w in c.lower() for w in EVENT_COLUMNS)]
    first = [c for c in df.columns[:1] if c not in like]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), X.strip(F.col(f"`{c}`")).alias("term")) for i, cs in enumerate((like, first)) for c in cs]))
    t = df.select(every.alias("x")).select("x.*").where("length(term) > 2").distinct()
    best = t.agg(F.min("rank").alias("rank"))
    return t.join(F.broadcast(best), "rank").select("term").distinct()  # best is one row


def lexicon(spark: SparkSession, raw: dict[str, DataFrame], builtin: dict[str, list[str]], entity_types: dict[str, str] | None = None) -> DataFrame:
    """(name, source, term): each name's raw terms that are safe to look for, else its built-in terms."""
    out = spark.createDataFrame([(n, t) for n, ts in builtin.items() for t in ts], "name string, term string").select("name", F.lit("builtin").alias("source"), X.surface(F.col("term")).alias("term"))
    found = spark.createDataFrame([], "name string, source string, term string")
    for name, df in raw.items():
        safe = df.where(X.mention_safe(F.col("term"), (entity_types or {}).get(name, "")))
        found = found.unionByName(safe.select(F.lit(name).alias("name"), F.lit("raw").alias("source"), "term"))
    names = found.select("name").distinct()
    return found.unionByName(out.join(names, "name", "left_anti")).where("term <> ''").distinct()
