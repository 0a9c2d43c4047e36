"""Registered queries over the base operators, each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import spans as S
from noteloom.functions import text as X
from noteloom.operators import relational as R
from noteloom.plans import roles
from noteloom.plans.roles import duck, role

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# what the oracles share, written for DuckDB

_NOISE = ", ".join(f"'{w}'" for w in X.NOISE_TOKENS)


def _re(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def _trim(x: str) -> str:
    return _re(_re(x, r"\s+"), "^ | $", "")


def _stripped(x: str, drugs: bool = True) -> str:
    t = _re(_re(f"lower(coalesce({x}, ''))", r"\([^)]*\)"), "[/_-]")
    for p in (X.DOSE, X.ROUTE, X.FORM, X.J_CODE, X.NDC, X.SITE_NOISE) if drugs else ():
        t = _re(t, p)
    return _trim(_re(t, r"[^a-z0-9\s]"))


def _norm(x: str, keep: int = 4, noise: bool = True) -> str:
    more = f" AND t NOT IN ({_NOISE})" if noise else ""
    return f"array_to_string(list_filter(string_split({_stripped(x)}, ' '), lambda t: length(t) >= 3{more})[1:{keep}], ' ')"


def _surface(x: str) -> str:
    return _trim(f"lower(coalesce({x}, ''))")


_NOTES = f"notes AS ({duck(roles.NOTES)})"
_MENTIONS = f"mentions AS ({duck(roles.MENTIONS)})"
_VOCAB = f"vocab AS ({duck(roles.VOCAB)})"
_AM = f"am AS (SELECT alias, arg_max(canonical, ord) AS canonical FROM (SELECT {_norm('alias_raw')} AS alias, canonical, ord FROM ({duck(roles.ALIASES)}) WHERE include) WHERE alias <> '' GROUP BY alias)"
_SM = f"sm AS (SELECT synonym, min(label) AS label FROM (SELECT {_norm('s')} AS synonym, canonical AS label FROM (SELECT canonical, unnest([canonical, syn]) AS s FROM vocab)) WHERE synonym <> '' GROUP BY synonym)"
_LADDER = f"""WITH {_MENTIONS}, {_VOCAB}, {_AM}, {_SM},
a AS (SELECT m.*, {_surface('raw')} AS a1, {_norm('raw')} AS a2 FROM mentions m),
b AS (SELECT a.*, coalesce(am.canonical, a2) AS a3 FROM a LEFT JOIN am ON a.a2 = am.alias),
c AS (SELECT b.*, coalesce(sm.label, '') AS vocab_label, {_norm('a3')} AS term FROM b LEFT JOIN sm ON b.a3 = sm.synonym),
p AS (SELECT mention_id, {_norm('p')} AS pn FROM (SELECT mention_id, unnest(regexp_split_to_array(term, '\\s*(?:/|\\+|plus|and|with)\\s*')) AS p FROM c WHERE regexp_matches(term, ' (plus|and|with) ') AND len(list_filter(regexp_split_to_array(term, '\\s*(?:/|\\+|plus|and|with)\\s*'), lambda z: trim(z) <> '')) >= 2)),
q AS (SELECT mention_id, count(DISTINCT sm.label) AS k, count(*) FILTER (sm.label IS NULL) AS open, min(sm.label) AS one FROM p LEFT JOIN sm ON pn = sm.synonym WHERE pn <> '' GROUP BY mention_id),
ladder AS (SELECT c.mention_id, raw, gold, a1, a2, a3, coalesce(CASE WHEN k = 1 AND open = 0 THEN one END, term) AS a4, vocab_label FROM c LEFT JOIN q ON c.mention_id = q.mention_id)
"""


def _ladder(spark, sf) -> DataFrame:
    vocab = role(spark, sf, roles.VOCAB).select("canonical", F.array("syn").alias("synonyms"))
    return R.normalization_ladder(role(spark, sf, roles.MENTIONS), role(spark, sf, roles.ALIASES), vocab)


@query(_LADDER + "SELECT mention_id, raw, gold, a1, a2, a3, a4, vocab_label FROM ladder")
def norm_detail(spark, sf):
    return _ladder(spark, sf)


@query(_LADDER + """, x AS (SELECT avg((a1 = gold)::INT) AS s1, avg((a2 = gold)::INT) AS s2, avg((a3 = gold)::INT) AS s3, avg((a4 = gold)::INT) AS s4 FROM ladder)
SELECT stage, accuracy, accuracy - lag(accuracy) OVER (ORDER BY stage) AS delta, accuracy - first_value(accuracy) OVER (ORDER BY stage) AS lift FROM (SELECT 1 AS stage, s1 AS accuracy FROM x UNION ALL SELECT 2, s2 FROM x UNION ALL SELECT 3, s3 FROM x UNION ALL SELECT 4, s4 FROM x)""")
def norm_ladder(spark, sf):
    ok = [F.avg((F.col(c) == F.col("gold")).cast("double")) for c in ("a1", "a2", "a3", "a4")]
    one = _ladder(spark, sf).agg(F.array(*ok).alias("s")).select(F.posexplode("s").alias("p", "accuracy")).select((F.col("p") + 1).alias("stage"), "accuracy")
    w = Window.orderBy("stage")
    return one.withColumn("delta", F.col("accuracy") - F.lag("accuracy").over(w)).withColumn("lift", F.col("accuracy") - F.first("accuracy").over(w))


@query(_LADDER + """SELECT CASE WHEN a1 = gold THEN 'surface' WHEN a2 = gold THEN 'lexical' WHEN a3 = gold THEN 'alias' WHEN a4 = gold THEN 'decomposition' ELSE 'unresolved' END AS stage, count(*) AS n FROM ladder GROUP BY 1""")
def stage_contribution(spark, sf):
    stage = F.when(F.col("a1") == F.col("gold"), "surface").when(F.col("a2") == F.col("gold"), "lexical").when(F.col("a3") == F.col("gold"), "alias").when(F.col("a4") == F.col("gold"), "decomposition").otherwise("unresolved")
    return _ladder(spark, sf).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


_LABS = ", ".join(f"'{w}'" for w in X.LAB_TERMS)
_ABBR = ", ".join(f"'{w}'" for w in X.ABBREVIATIONS)


@query(_LADDER + f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN list_has_any(string_split(a2, ' '), [{_LABS}]) THEN 'lab/substance/non-medication'
WHEN regexp_matches(lower(raw), '{X.VAGUE}') THEN 'vague class term'
WHEN regexp_matches(lower(raw), '{"|".join((X.COMBO, X.SALTS, X.FORMS))}') OR regexp_matches(lower(gold), '{"|".join((X.COMBO, X.SALTS, X.FORMS))}') THEN 'combination/formulation mismatch'
WHEN a2 = '' OR a2 IN ({_ABBR}) OR (len(string_split(a2, ' ')) = 1 AND length(a2) <= 4) OR length({_re('lower(raw)', '[^A-Za-z0-9]', '')}) BETWEEN 1 AND 4 THEN 'ambiguous abbreviation'
WHEN regexp_matches(lower(raw), '{X.UNCLEAR}') THEN 'unclear canonical target' ELSE 'missing alias' END AS category FROM ladder WHERE a4 <> gold) GROUP BY category""")
def failure_taxonomy(spark, sf):
    rows = _ladder(spark, sf).where("a4 <> gold").select(X.failure_category(F.col("raw"), F.col("a2"), F.col("gold")).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT alias, count(DISTINCT canonical) AS n_canonical FROM (SELECT {_norm('alias_raw')} AS alias, canonical FROM ({duck(roles.ALIASES)}) WHERE include) WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT canonical) > 1")
def alias_conflicts(spark, sf):
    a = role(spark, sf, roles.ALIASES).where("include").select(X.drug_norm(F.col("alias_raw")).alias("alias"), "canonical").where("alias <> ''")
    return a.groupBy("alias").agg(F.countDistinct("canonical").alias("n_canonical")).where("n_canonical > 1")


@query(f"SELECT p_partkey, {_norm('raw')} AS x01, {_norm('raw', 3)} AS x02, {_norm('raw', 3, False)} AS x03 FROM (SELECT p_partkey, 'J9267 ' || p_name || ' (' || p_brand || ') ' || p_size || 'mg/' || p_type || ' pain tabs NDC: ' || p_partkey AS raw FROM part)")
def drug_normalizers(spark, sf):
    raw = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "'J9267 ' || p_name || ' (' || p_brand || ') ' || p_size || 'mg/' || p_type || ' pain tabs NDC: ' || p_partkey AS raw")
    return raw.select("p_partkey", X.drug_norm(F.col("raw")).alias("x01"), X.term_norm(F.col("raw"), "drugs").alias("x02"), X.drug_norm(F.col("raw"), 3, False).alias("x03"))


# notes


def _notes(spark, sf) -> DataFrame:
    return role(spark, sf, roles.NOTES)


_OWN_TRIM = r"trim(note_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_MARK = "|".join(X.TEMPLATE_MARKERS)


@query(f"""WITH {_NOTES}, f AS (SELECT visit_id > 0 AS a, {_OWN_TRIM} <> '' AS b, length({_OWN_TRIM}) >= 100 AS c, note_title IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9') AS d, NOT (length({_OWN_TRIM}) < 40 OR regexp_matches(lower(note_text), '{_MARK}')) AS e FROM notes)
SELECT 0 AS step, 'all' AS name, count(*) AS n FROM f UNION ALL SELECT 1, 'valid_ids', count(*) FROM f WHERE a UNION ALL SELECT 2, 'non_blank', count(*) FROM f WHERE a AND b UNION ALL SELECT 3, 'min_chars', count(*) FROM f WHERE a AND b AND c UNION ALL SELECT 4, 'type_listed', count(*) FROM f WHERE a AND b AND c AND d UNION ALL SELECT 5, 'not_template', count(*) FROM f WHERE a AND b AND c AND d AND e""")
def note_funnel(spark, sf):
    t = X.strip(F.col("note_text"))
    return R.funnel(_notes(spark, sf), [("valid_ids", F.col("visit_id") > 0), ("non_blank", t != ""), ("min_chars", F.length(t) >= 100), ("type_listed", F.lower("note_title").isin(*[f"src{i}" for i in range(10)])), ("not_template", ~X.template_like(F.col("note_text")))])


@query(f"""WITH {_NOTES}, twice AS (SELECT *, 0 AS ord FROM notes UNION ALL SELECT note_id, visit_id, person_id, note_title, note_text, CASE WHEN note_id % 3 = 0 THEN NULL ELSE note_day + 1 END, 1 FROM notes WHERE note_id % 2 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY note_day DESC NULLS FIRST, ord DESC) AS r FROM twice),
b AS (SELECT *, row_number() OVER (PARTITION BY person_id, visit_id, {_surface('note_text')} ORDER BY note_day NULLS LAST, ord, note_id) AS q FROM a WHERE r = 1)
SELECT note_id, visit_id, ord, note_day FROM b WHERE q = 1""")
def note_dedup(spark, sf):
    n = _notes(spark, sf)
    again = n.where("note_id % 2 = 0").withColumn("note_day", F.when(F.col("note_id") % 3 == 0, F.lit(None)).otherwise(F.col("note_day") + 1))
    twice = n.withColumn("ord", F.lit(0)).unionByName(again.withColumn("ord", F.lit(1)))
    last = R.keep_first(twice, ["note_id"], F.col("note_day").desc_nulls_first(), F.col("ord").desc())
    last = last.withColumn("key", F.sha2(X.surface(F.col("note_text")), 256))
    return R.keep_first(last, ["person_id", "visit_id", "key"], F.col("note_day").asc_nulls_last(), F.col("ord"), F.col("note_id")).select("note_id", "visit_id", "ord", "note_day")


@query(f"""WITH {_NOTES}, v AS (SELECT person_id, visit_id, count(DISTINCT note_id) AS notes, median(length(note_text)) AS median_len, max(length(note_text))::BIGINT AS max_len FROM notes GROUP BY 1, 2),
m AS (SELECT person_id, visit_id, note_title AS mode FROM (SELECT *, row_number() OVER (PARTITION BY person_id, visit_id ORDER BY n DESC, note_title) AS r FROM (SELECT person_id, visit_id, note_title, count(*) AS n FROM notes GROUP BY 1, 2, 3)) WHERE r = 1)
SELECT v.person_id, v.visit_id, notes, median_len::DOUBLE AS median_len, max_len, mode, count(*) OVER (PARTITION BY v.person_id) AS patient_visits, CASE WHEN notes <= 1 THEN '01' WHEN notes <= 3 THEN '02-03' WHEN notes <= 6 THEN '04-06' WHEN notes <= 12 THEN '07-12' ELSE '13+' END AS bin FROM v JOIN m ON v.person_id = m.person_id AND v.visit_id = m.visit_id""")
def visit_rollup(spark, sf):
    n = F.length("note_text")
    v = _notes(spark, sf).groupBy("person_id", "visit_id").agg(F.countDistinct("note_id").alias("notes"), F.median(n).alias("median_len"), F.max(n).cast("long").alias("max_len"), F.mode("note_title", True).alias("mode"))
    return v.withColumn("patient_visits", F.count("*").over(Window.partitionBy("person_id"))).withColumn("bin", X.visit_count_bin(F.col("notes")))


@query(f"""WITH {_NOTES}, m AS (SELECT max(length(note_text)) AS m FROM notes)
SELECT (SELECT m FROM m)::BIGINT AS max_len, avg((length(note_text) = (SELECT m FROM m))::INT) AS at_max, avg((length(note_text) = 2000)::INT) AS at_2000, avg((length(note_text) >= 1800)::INT) AS ge_1800, quantile_cont(length(note_text), 0.5)::DOUBLE AS p50, quantile_cont(length(note_text), 0.9)::DOUBLE AS p90 FROM notes""")
def truncation_profile(spark, sf):
    n = _notes(spark, sf).select(F.length("note_text").alias("n"))
    top = n.agg(F.max("n").alias("m"))
    share = lambda c: F.avg(c.cast("double"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    one = n.crossJoin(F.broadcast(top)).agg(F.max("m").cast("long").alias("max_len"), share(F.col("n") == F.col("m")).alias("at_max"), share(F.col("n") == 2000).alias("at_2000"), share(F.col("n") >= 1800).alias("ge_1800"), p.alias("p"))
    return one.select("max_len", "at_max", "at_2000", "ge_1800", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


@query(f"WITH {_NOTES} SELECT note_id, person_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sha1('s' || note_id), note_id) AS r FROM notes) WHERE r <= 3")
def patient_cap(spark, sf):
    return R.cap_per_key(_notes(spark, sf), "person_id", "note_id", 3, "s").select("note_id", "person_id")


@query(f"""WITH {_NOTES}, c AS (SELECT note_title, count(*) AS c, sum(count(*)) OVER () AS total FROM notes GROUP BY 1), q AS (SELECT note_title, c, CASE WHEN total <= 100 THEN c ELSE greatest(1, c * 100 // total) END AS q, least(total, 100) AS n FROM c),
s AS (SELECT note_title, q, n - sum(q) OVER () AS rest, c - q AS room, coalesce(sum(c - q) OVER (ORDER BY c DESC, note_title NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM q)
SELECT note_id, note_title FROM (SELECT note_id, n.note_title, q + greatest(0, least(room, rest - taken)) AS quota, row_number() OVER (PARTITION BY n.note_title ORDER BY sha1('s' || note_id), note_id) AS r FROM notes n JOIN s ON n.note_title IS NOT DISTINCT FROM s.note_title) WHERE r <= quota""")
def stratified_notes(spark, sf):
    return R.stratified_sample(_notes(spark, sf), "note_title", "note_id", 100, "s").select("note_id", "note_title")


@query(f"WITH {_NOTES} SELECT CASE WHEN n < 250 THEN 'lt_250' WHEN n < 750 THEN '250_749' WHEN n < 1500 THEN '750_1499' ELSE 'ge_1500' END AS bin, count(*) AS n FROM (SELECT length(note_text) AS n FROM notes) GROUP BY 1")
def note_length_bins(spark, sf):
    return _notes(spark, sf).groupBy(X.note_length_bin(F.length("note_text")).alias("bin")).agg(F.count("*").alias("n"))


# text extraction

LEXICON = (("and", "start"), ("the", "stop"), ("with", "hold"), ("by", "dose_change"), ("for", "toxicity"), ("that", "progression"), ("of", "regimen"))
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(LEXICON)) + ") AS l(ord, term, category))"
_HITS = rf"""{_NOTES}, {_LEX}, tok AS (SELECT note_id, unnest(regexp_extract_all(note_text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+')) AS t, generate_subscripts(regexp_extract_all(note_text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'), 1) AS i FROM notes),
pos AS (SELECT note_id, t, sum(length(t)) OVER (PARTITION BY note_id ORDER BY i) - length(t) AS b FROM tok), hits AS (SELECT note_id, category, b::BIGINT AS span_begin, (b + length(t))::BIGINT AS span_end, t AS match FROM pos JOIN lex ON lower(t) = term)"""


def _category(match):
    return F.coalesce(*[F.when(F.lower(match) == t, F.lit(c)) for t, c in LEXICON])


def _hits(spark, sf) -> DataFrame:
    # one pattern for all categories: of terms that start at one place the longest matches
    n = _notes(spark, sf).select("note_id", "visit_id", "person_id", "note_text", F.explode(S.matches(F.col("note_text"), S.phrase_pattern([t for t, _ in LEXICON]))).alias("m"))
    return n.select("note_id", "visit_id", "person_id", "note_text", _category(F.col("m.match")).alias("category"), F.col("m.begin").cast("long").alias("span_begin"), F.col("m.end").cast("long").alias("span_end"), F.col("m.match").alias("match"))


@query(f"WITH {_HITS} SELECT note_id, category, span_begin, span_end, match FROM hits")
def phrase_hits(spark, sf):
    return _hits(spark, sf).select("note_id", "category", "span_begin", "span_end", "match")


@query(f"""WITH {_HITS} SELECT n.person_id, n.visit_id, count(*) AS n_spans, count(DISTINCT h.note_id) AS n_notes, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories,
CASE WHEN count(*) <= 1 THEN '01' WHEN count(*) <= 3 THEN '02-03' WHEN count(*) <= 7 THEN '04-07' ELSE '08+' END AS bin FROM hits h JOIN notes n ON h.note_id = n.note_id GROUP BY 1, 2""")
def candidates_by_visit(spark, sf):
    g = _hits(spark, sf).groupBy("person_id", "visit_id").agg(F.count("*").alias("n_spans"), F.countDistinct("note_id").alias("n_notes"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return g.withColumn("bin", X.candidate_count_bin(F.col("n_spans")))


@query(r"""WITH t AS (SELECT doc_id AS note_id, regexp_replace(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), '([^\s' || chr(1) || ']|[ \t\r\f\v])(\n+)', '\1\2' || chr(1), 'g') AS x FROM documents)
SELECT note_id, len(list_filter(string_split(x, chr(1)), lambda s: s <> ''))::BIGINT AS n_sentences, list_max(list_transform(string_split(x, chr(1)), lambda s: length(s)))::BIGINT AS longest FROM t""")
def sentence_counts(spark, sf):
    s = S.sentences(F.col("note_text"))
    n = _notes(spark, sf).select("note_id", F.when(F.col("note_text") == "", 0).otherwise(F.size(s)).cast("long").alias("n_sentences"), F.array_max(F.transform(s, lambda x: x["end"] - x["begin"])).cast("long").alias("longest"))
    return n


@query(rf"""WITH {_HITS}, t AS (SELECT note_id, regexp_replace(regexp_replace(note_text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), '([^\s' || chr(1) || ']|[ \t\r\f\v])(\n+)', '\1\2' || chr(1), 'g') AS x FROM notes),
u AS (SELECT note_id, unnest(string_split(x, chr(1))) AS s, generate_subscripts(string_split(x, chr(1)), 1) AS i FROM t), cut AS (SELECT note_id, s, sum(length(s)) OVER (PARTITION BY note_id ORDER BY i) AS e FROM u),
sp AS (SELECT h.*, trim(regexp_replace(s, '\s+', ' ', 'g')) AS span FROM hits h JOIN cut ON h.note_id = cut.note_id AND span_begin < e AND span_begin >= e - length(s))
SELECT note_id, category, match, span_begin, span FROM (SELECT *, row_number() OVER (PARTITION BY note_id, span, category ORDER BY span_begin) AS r FROM sp WHERE length(span) > 15) WHERE r = 1""")
def candidate_spans(spark, sf):
    # sentences are cut once for each note, below the step that makes a row for each match
    notes = _notes(spark, sf).select("note_id", "note_text", S.sentences(F.col("note_text")).alias("cuts"))
    cuts = notes.select("note_id", "note_text", "cuts", F.explode(S.matches(F.col("note_text"), S.phrase_pattern([t for t, _ in LEXICON]))).alias("m"))
    span = S.span_text(F.col("note_text"), F.col("cuts"), F.col("m.begin"), F.col("m.end"))
    h = cuts.select("note_id", _category(F.col("m.match")).alias("category"), F.col("m.match").alias("match"), F.col("m.begin").cast("long").alias("span_begin"), span.alias("span")).where("length(span) > 15")
    return R.keep_first(h, ["note_id", "span", "category"], F.col("span_begin")).select("note_id", "category", "match", "span_begin", "span")


_TARGET = "(['" + "', '".join(t for t, _ in LEXICON) + f"', ''])[person_id % {len(LEXICON) + 1} + 1]"


@query(f"WITH {_HITS} SELECT h.note_id, span_begin, span_end, match FROM hits h JOIN notes n ON h.note_id = n.note_id WHERE lower(match) = {_TARGET}")
def target_hits(spark, sf):
    target = F.element_at(F.array(*[F.lit(t) for t, _ in LEXICON], F.lit("")), (F.col("person_id") % (len(LEXICON) + 1) + 1).cast("int"))
    n = _notes(spark, sf).select("note_id", F.explode(S.matches(F.col("note_text"), S.target_pattern(target))).alias("m"))
    return n.select("note_id", F.col("m.begin").cast("long").alias("span_begin"), F.col("m.end").cast("long").alias("span_end"), F.col("m.match").alias("match"))


# structured records and concordance

_EHR = f"ehr AS ({duck(roles.EHR)})"


def _ehr(spark, sf) -> DataFrame:
    return role(spark, sf, roles.EHR)


@query(f"""WITH {_EHR}, d AS (SELECT person_id, visit_id, drug, condition, measurement, proc FROM ehr)
SELECT person_id, visit_id, array_to_string(list_sort(list(DISTINCT lower(drug))), '|') AS drugs, array_to_string(list_sort(list(DISTINCT lower(condition))), '|') AS conditions, array_to_string(list_sort(list(DISTINCT lower(measurement))), '|') AS measurements, array_to_string(list_sort(list(DISTINCT lower(proc))), '|') AS procedures FROM d GROUP BY 1, 2""")
def ehr_by_visit(spark, sf):
    e = _ehr(spark, sf)
    kinds = [("drug", "drugs"), ("condition", "conditions"), ("measurement", "measurements"), ("proc", "procedures")]
    return e.groupBy("person_id", "visit_id").agg(*[F.array_join(F.array_sort(F.collect_set(X.clean(F.col(a)))), "|").alias(b) for a, b in kinds])


@query("SELECT o_custkey AS person_id, o_orderkey AS visit_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders")
def timeline_rank(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("visit_id"), "o_orderdate")
    return R.visit_ranks(o, "person_id", "visit_id", "o_orderdate").select("person_id", "visit_id", F.col("rank").cast("long").alias("rank"))


def _pairs(spark, sf, k: int) -> DataFrame:
    e = _ehr(spark, sf)
    terms = lambda c: F.array_sort(F.collect_set(c))
    note = e.where("line <= 2").select("person_id", "visit_id", F.when(F.col("part") % 5 == 0, F.concat(F.lit("new "), F.split("drug", " ")[1])).otherwise(F.col("drug")).alias("t")).groupBy("person_id", "visit_id").agg(terms("t").alias("note_terms"))
    other = e.groupBy("person_id", "visit_id", "visit_date").agg(terms("drug").alias("ehr_terms"))
    other = R.windowed_union(R.visit_ranks(other, "person_id", "visit_id", "visit_date"), "person_id", "ehr_terms", k)
    return R.concordance(note.join(other.select("person_id", "visit_id", "ehr_terms"), ["person_id", "visit_id"]))


def _pairs_sql(k: int) -> str:
    tok = lambda x: f"list_filter(string_split({x}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({_NOISE}))"
    rel = f"(a = b OR (length(a) >= 4 AND contains(b, a)) OR (length(b) >= 4 AND contains(a, b)) OR (len(list_intersect({tok('a')}, {tok('b')})) > 0 AND len(list_distinct(list_intersect({tok('a')}, {tok('b')}))) / least(len(list_distinct({tok('a')})), len(list_distinct({tok('b')}))) >= 0.5))"
    return f"""WITH {_EHR}, n AS (SELECT person_id, visit_id, list_sort(list(DISTINCT CASE WHEN part % 5 = 0 THEN 'new ' || split_part(drug, ' ', 2) ELSE drug END)) AS nt FROM ehr WHERE line <= 2 GROUP BY 1, 2),
v AS (SELECT person_id, visit_id, row_number() OVER (PARTITION BY person_id ORDER BY visit_date, visit_id) AS r FROM (SELECT DISTINCT person_id, visit_id, visit_date FROM ehr)),
e AS (SELECT v.person_id, v.visit_id, list_sort(list(DISTINCT drug)) AS et FROM v JOIN v v2 ON v.person_id = v2.person_id AND v2.r BETWEEN v.r - {k} AND v.r + {k} JOIN ehr ON ehr.person_id = v2.person_id AND ehr.visit_id = v2.visit_id GROUP BY 1, 2),
j AS (SELECT n.person_id, n.visit_id, nt, et FROM n JOIN e ON n.person_id = e.person_id AND n.visit_id = e.visit_id),
h AS (SELECT person_id, visit_id, sum(hit) AS hits FROM (SELECT person_id, visit_id, a, max(({rel})::INT) AS hit FROM (SELECT person_id, visit_id, a, unnest(et) AS b FROM (SELECT person_id, visit_id, unnest(nt) AS a, et FROM j)) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT j.person_id, j.visit_id, len(list_intersect(nt, et)) / len(list_distinct(list_concat(nt, et))) AS jaccard, len(list_intersect(nt, et)) / len(nt) AS containment, hits / len(nt) AS containment_relaxed, len(nt)::BIGINT AS note_n, len(et)::BIGINT AS ehr_n, (len(list_intersect(nt, et)) > 0)::INT AS has_overlap, (hits > 0)::INT AS has_overlap_relaxed FROM j JOIN h ON j.person_id = h.person_id AND j.visit_id = h.visit_id"""


@query(_pairs_sql(0))
def concordance_k0(spark, sf):
    return _pairs(spark, sf, 0)


@query(_pairs_sql(1))
def concordance_k1(spark, sf):
    return _pairs(spark, sf, 1)


@query(f"SELECT count(*) AS n_pairs, round(avg(jaccard), 9) AS mean_jaccard, round(avg(containment), 9) AS mean_containment, round(avg(containment_relaxed), 9) AS mean_relaxed, round(avg(has_overlap), 9) AS overlap_rate, round(avg(note_n), 9) AS mean_note, round(avg(ehr_n), 9) AS mean_ehr FROM ({_pairs_sql(2)})")
def concordance_summary_k2(spark, sf):
    a = lambda c, n: F.round(F.avg(c), 9).alias(n)
    return _pairs(spark, sf, 2).agg(F.count("*").alias("n_pairs"), a("jaccard", "mean_jaccard"), a("containment", "mean_containment"), a("containment_relaxed", "mean_relaxed"), a("has_overlap", "overlap_rate"), a("note_n", "mean_note"), a("ehr_n", "mean_ehr"))


# adjudication and metrics

_ALIGN = f"""WITH s AS ({duck(roles.SEEDS)}), t AS ({duck(roles.TRUTH)}),
u AS (SELECT unit_id, max(ord) AS o1 FROM s GROUP BY 1), sp AS (SELECT note_id, span_id, lower(raw) AS norm, min(ord) AS o2, count(*) AS n2 FROM s GROUP BY 1, 2, 3), nt AS (SELECT note_id, lower(raw) AS norm, min(ord) AS o3, count(*) AS n3 FROM s GROUP BY 1, 2),
j AS (SELECT t.truth_id, t.note_id, coalesce(o1, o2, o3) AS seed_ord, CASE WHEN o1 IS NOT NULL THEN 'adjudication_unit_id' WHEN n2 = 1 THEN 'note_span_mention' WHEN n2 > 1 THEN 'note_span_mention_multi' WHEN n3 = 1 THEN 'note_mention' WHEN n3 > 1 THEN 'note_mention_multi' ELSE 'unmatched_truth_row' END AS join_method FROM t LEFT JOIN u ON t.unit_id = u.unit_id LEFT JOIN sp ON t.note_id = sp.note_id AND t.span_id = sp.span_id AND lower(t.raw) = sp.norm LEFT JOIN nt ON t.note_id = nt.note_id AND lower(t.raw) = nt.norm),
al AS (SELECT CASE WHEN seed_ord IS NULL THEN 'false_negative' ELSE 'matched' END AS alignment_status, join_method, CASE join_method WHEN 'note_span_mention_multi' THEN 'multiple_seed_candidates_same_span_mention' WHEN 'note_mention_multi' THEN 'multiple_seed_candidates_same_note_mention' ELSE '' END AS audit_flag, truth_id, seed_ord, note_id FROM j
UNION ALL SELECT 'false_positive', 'unmatched_seed_row', 'needs_manual_review_if_true_mention_missed_in_adjudication', NULL, ord, note_id FROM s WHERE ord NOT IN (SELECT seed_ord FROM j WHERE seed_ord IS NOT NULL))
"""
_PRF = "coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * (coalesce(tp / nullif(tp + fp, 0), 0)) * (coalesce(tp / nullif(tp + fn, 0), 0)) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0)::DOUBLE AS f1"
_COUNTS = "count(*) FILTER (alignment_status = 'matched') AS tp, count(*) FILTER (alignment_status = 'false_positive') AS fp, count(*) FILTER (alignment_status = 'false_negative') AS fn"


def _aligned(spark, sf) -> DataFrame:
    return R.outer_alignment(role(spark, sf, roles.TRUTH), role(spark, sf, roles.SEEDS))


@query(_ALIGN + "SELECT * FROM al")
def alignment_tiers(spark, sf):
    return _aligned(spark, sf)


@query(_ALIGN + f"SELECT *, {_PRF} FROM (SELECT {_COUNTS} FROM al)")
def extraction_prf(spark, sf):
    return R.prf(_aligned(spark, sf))


@query(_ALIGN + f""", nn AS ({duck(roles.NOTES)}), per AS (SELECT visit_id, count(*) AS k FROM nn GROUP BY 1), d AS (SELECT n.note_id, note_title, CASE WHEN k <= 4 THEN 'few' ELSE 'many' END AS visit_size, CASE WHEN length(note_text) < 300 THEN 'lt_300' WHEN length(note_text) < 1500 THEN '300_1500' ELSE 'ge_1500' END AS chars FROM nn n JOIN per USING (visit_id)),
e AS (SELECT al.*, note_title, visit_size, chars FROM al LEFT JOIN d ON al.note_id = d.note_id), dims AS (SELECT *, unnest(['note_title', 'visit_size', 'note_length']) AS dimension, coalesce(unnest([note_title, visit_size, chars]), 'unknown') AS slice FROM e)
SELECT *, {_PRF} FROM (SELECT dimension, slice, {_COUNTS} FROM dims GROUP BY 1, 2)""")
def slice_metrics(spark, sf):
    n = role(spark, sf, roles.NOTES)
    size = F.when(F.count("*").over(Window.partitionBy("visit_id")) <= 4, "few").otherwise("many")
    chars = F.when(F.length("note_text") < 300, "lt_300").when(F.length("note_text") < 1500, "300_1500").otherwise("ge_1500")
    d = n.select("note_id", "note_title", size.alias("visit_size"), chars.alias("note_length"))
    return R.slices(_aligned(spark, sf), d, "note_id", ["note_title", "visit_size", "note_length"])


_STATUS = "[" + ", ".join(f"'{s}'" for s in X.STATUSES) + "]"
_GROUP = "CASE WHEN s IN ('active_current', 'newly_started_or_prescribed', 'planned_or_considering') THEN 'current_or_intended' WHEN s = 'unclear' THEN 'unclear' ELSE 'not_current' END"


@query(f"SELECT {_GROUP} AS truth, CASE event_type WHEN 'click' THEN 'start' ELSE event_type END AS predicted, count(*) AS n FROM (SELECT {_STATUS}[(event_id % 8 + 1)::INT] AS s, event_type FROM events) GROUP BY 1, 2")
def status_confusion(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = F.element_at(F.array(*map(F.lit, X.STATUSES)), (F.col("event_id") % 8 + 1).cast("int"))
    return e.groupBy(X.grouped_status(s).alias("truth"), F.when(F.col("event_type") == "click", "start").otherwise(F.col("event_type")).alias("predicted")).agg(F.count("*").alias("n"))


@query("SELECT event_id, 'm_' || substr(sha1(event_id || '||' || user_id || '||' || event_type), 1, 16) AS unit_id FROM events")
def stable_ids(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.stable_id("m_", F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("unit_id"))


@query("""WITH v AS (SELECT count(*) AS n FROM events GROUP BY user_id) SELECT min(n) AS least, quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.75)::DOUBLE AS p75, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.95)::DOUBLE AS p95, quantile_cont(n, 0.99)::DOUBLE AS p99, max(n) AS most, avg(n) AS mean FROM v""")
def packet_distribution(spark, sf):
    v = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    qs = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    one = v.agg(F.min("n").alias("least"), F.percentile("n", F.array(*map(F.lit, qs))).alias("p"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return one.select("least", *[F.col("p")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(qs)], "most", "mean")


@query(f"""WITH s AS (SELECT unit_id, raw, 'old' AS note FROM ({duck(roles.SEEDS)})),
d AS (SELECT 'u' || (event_id % 2000) AS unit_id, event_id AS ord, CASE event_id % 9 WHEN 0 THEN 'drop_row' WHEN 1 THEN 'needs_manual_followup' ELSE 'keep' END AS review_action, 'raw' || event_id AS raw, 'new' AS note FROM events WHERE event_id % 3 = 0),
l AS (SELECT unit_id, arg_max(review_action, ord) AS act, arg_max(raw, ord) AS r, arg_max(note, ord) AS n, bool_or(review_action = 'drop_row') AS dropped FROM d GROUP BY 1)
SELECT s.unit_id, coalesce(r, raw) AS raw, coalesce(n, note) AS note, coalesce(act = 'needs_manual_followup', false) AS followup FROM s LEFT JOIN l ON s.unit_id = l.unit_id WHERE NOT coalesce(dropped, false)""")
def patched_rows(spark, sf):
    s = role(spark, sf, roles.SEEDS).select("unit_id", "raw", F.lit("old").alias("note"))
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 3 = 0")
    d = e.selectExpr("concat('u', event_id % 2000) AS unit_id", "event_id AS ord", "CASE event_id % 9 WHEN 0 THEN 'drop_row' WHEN 1 THEN 'needs_manual_followup' ELSE 'keep' END AS review_action", "concat('raw', event_id) AS raw", "'new' AS note")
    return R.apply_patch(s, d, ["raw", "note"])


_BANDS = [(i / 10, (i + 1) / 10) for i in range(10)]


@query(f"WITH s AS ({duck(roles.SCORES)}), b AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _BANDS)}) AS b(band_min, band_max)) SELECT band_min, band_max, count(id) AS n, count(*) FILTER (accepted) AS accepted_n, coalesce(count(*) FILTER (accepted AND correct) / nullif(count(*) FILTER (accepted), 0), 0)::DOUBLE AS accepted_precision, coalesce(count(*) FILTER (accepted) / nullif(count(id), 0), 0)::DOUBLE AS coverage FROM b LEFT JOIN s ON score >= band_min AND score <= band_max GROUP BY 1, 2")
def calibration_bands(spark, sf):
    s = role(spark, sf, roles.SCORES).withColumn("score", F.col("score").cast("double"))
    # both ends belong to a band: a score on an edge counts in two
    b = F.array(*[F.struct(F.lit(x).alias("band_min"), F.lit(y).alias("band_max")) for x, y in _BANDS])
    hit = s.withColumn("b", F.explode(F.filter(b, lambda x: (F.col("score") >= x["band_min"]) & (F.col("score") <= x["band_max"]))))
    g = hit.groupBy("b.band_min", "b.band_max").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted_n"), F.count_if(F.col("accepted") & F.col("correct")).alias("ok"))
    every = spark.range(1).select(F.explode(b).alias("b")).select("b.*")
    g = every.join(g, ["band_min", "band_max"], "left").na.fill(0)
    return g.select("band_min", "band_max", "n", "accepted_n", F.coalesce(F.try_divide("ok", "accepted_n"), F.lit(0.0)).alias("accepted_precision"), F.coalesce(F.try_divide("accepted_n", "n"), F.lit(0.0)).alias("coverage"))


@query(f"""WITH s AS ({duck(roles.SCORES)}), q AS (SELECT quantile_cont(score::DOUBLE, 0.9) AS p90 FROM s) SELECT id, CASE WHEN score::DOUBLE >= (SELECT p90 FROM q) THEN 'A' WHEN kind = 'click' THEN 'B' ELSE 'C' END AS priority FROM s WHERE NOT correct""")
def review_priority(spark, sf):
    s = role(spark, sf, roles.SCORES).withColumn("score", F.col("score").cast("double"))
    q = s.agg(F.percentile("score", F.lit(0.9)).alias("p90"))
    p = F.when(F.col("score") >= F.col("p90"), "A").when(F.col("kind") == "click", "B").otherwise("C")
    return s.where("not correct").crossJoin(F.broadcast(q)).select("id", p.alias("priority"))


_DENSITY = "CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n = 3 THEN '3' WHEN n = 4 THEN '4' ELSE '>=5' END"


@query(f"SELECT bin, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS running FROM (SELECT {_DENSITY} AS bin, count(*) AS n FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1)")
def mention_density(spark, sf):
    per = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("k"))
    g = per.groupBy(X.mention_density_bin(F.col("k")).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.select("bin", "n", (F.col("n") / total).alias("share"), (F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / total).alias("running"))


@query("""SELECT event_type AS term, count(*) AS mentions, count(DISTINCT user_id % 40) AS visits, count(DISTINCT user_id) AS persons, array_to_string(list_sort(list(DISTINCT 'v' || (event_id % 37)))[1:5], '|') AS examples FROM events GROUP BY 1 HAVING count(*) >= 10""")
def unresolved_terms(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    g = e.groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("mentions"), F.countDistinct(F.col("user_id") % 40).alias("visits"), F.countDistinct("user_id").alias("persons"), F.array_join(F.slice(F.array_sort(F.collect_set(F.concat(F.lit("v"), F.col("event_id") % 37))), 1, 5), "|").alias("examples"))
    return g.where("mentions >= 10")


@query(f"""WITH {_VOCAB}, {_SM} SELECT canonical, syn AS synonyms, 1::BIGINT AS n_synonyms, (SELECT count(*) FROM sm WHERE label = canonical) AS resolved FROM vocab""")
def vocabulary(spark, sf):
    v = role(spark, sf, roles.VOCAB).select("canonical", F.array("syn").alias("synonyms"))
    n = R.synonym_map(v).groupBy(F.col("label").alias("canonical")).agg(F.count("*").alias("resolved"))
    return v.join(n, "canonical", "left").select("canonical", F.array_join("synonyms", "|").alias("synonyms"), F.size("synonyms").cast("long").alias("n_synonyms"), F.coalesce("resolved", F.lit(0)).alias("resolved"))


_GRAMS = "list_concat(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)), list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4)))"


@query(f"""WITH m AS (SELECT DISTINCT substr(p_name, 1, 3) || substr(p_name, 5) AS mention FROM part), c AS (SELECT DISTINCT p_name AS label FROM part),
cg AS (SELECT label, g, count(*) AS tf FROM (SELECT label, unnest({_GRAMS}) AS g FROM (SELECT label, ' ' || label || ' ' AS p FROM c)) GROUP BY 1, 2), idf AS (SELECT g, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM cg GROUP BY g),
cw AS (SELECT label, cg.g, tf * idf AS w FROM cg JOIN idf ON cg.g = idf.g), mg AS (SELECT mention, g, count(*) AS tf FROM (SELECT mention, unnest({_GRAMS}) AS g FROM (SELECT mention, ' ' || mention || ' ' AS p FROM m)) GROUP BY 1, 2),
mw AS (SELECT mention, mg.g, tf * coalesce(idf, 1) AS w FROM mg LEFT JOIN idf ON mg.g = idf.g), d AS (SELECT mention, label, sum(mw.w * cw.w) AS dot FROM mw JOIN cw ON mw.g = cw.g GROUP BY 1, 2),
s AS (SELECT d.mention, d.label, round(dot / ((SELECT sqrt(sum(w * w)) FROM mw WHERE mw.mention = d.mention) * (SELECT sqrt(sum(w * w)) FROM cw WHERE cw.label = d.label)), 9) AS score FROM d)
SELECT mention, label FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""")
def tfidf_top1(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    m = p.selectExpr("substr(p_name, 1, 3) || substr(p_name, 5) AS mention")
    return R.tfidf_best(m, p.select(F.col("p_name").alias("label")).distinct()).select("mention", "label")


@query("SELECT lower(event_type) AS value, count(*) AS n FROM events WHERE lower(event_type) NOT IN ('click', 'view') GROUP BY 1")
def enum_violations(spark, sf):
    return R.unexpected_values(spark.read.parquet(f"{sf}/events.parquet"), "event_type", ("click", "view"))


@query("SELECT c_custkey, regexp_replace(c_custkey || '.0', '\\.0+$', '') AS sid, c_custkey AS nid FROM customer")
def canonical_ids(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 ")).alias("x"))
    return c.select("c_custkey", X.string_id(F.col("x")).alias("sid"), X.number_id(X.strip(F.col("x"))).alias("nid"))
