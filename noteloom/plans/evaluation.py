"""Registered queries over evaluated mentions and lint of alias tables, each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.operators import evaluation as V
from noteloom.plans import core, roles
from noteloom.plans.roles import duck, role

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_DETAIL = """SELECT event_id AS id, event_type AS raw, 'g' || event_id % 7 AS gold, CASE WHEN event_id % 4 = 0 THEN 'g' || event_id % 7 ELSE 'x' END AS baseline, CASE WHEN event_id % 5 < 2 THEN 'g' || event_id % 7 WHEN event_id % 5 = 2 THEN NULL ELSE 'z' END AS plain,
CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'y' ELSE 'g' || event_id % 7 END AS linked, event_id % 3 <> 1 AS accepted, CASE event_id % 9 WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'low_margin,mention_too_short' WHEN 2 THEN 'ambiguous_short_term' ELSE 'low_margin' END AS reasons,
CASE event_id % 4 WHEN 0 THEN 'path_a_exact_vocab' WHEN 1 THEN ' path_a_exact_vocab ' ELSE 'path_b_canonical_transparent' END AS pathb_stage, (event_id % 100) / 500.0 AS margin FROM {events}"""


def _detail(spark, sf) -> DataFrame:
    return role(spark, sf, _DETAIL)


@query(f"""WITH d AS (SELECT raw, gold, baseline, coalesce(plain, '') AS plain, linked, accepted, string_split(reasons, ',') AS r FROM ({duck(_DETAIL)})), b AS (SELECT raw, CASE
WHEN accepted AND linked = gold AND plain <> gold THEN 'pathb_recovered_leftover' WHEN plain = gold AND baseline <> gold THEN 'alias_miss' WHEN plain = gold AND linked = gold THEN 'patha_solved'
WHEN plain <> gold AND NOT accepted THEN CASE WHEN list_contains(r, 'no_candidates') THEN 'vocabulary_miss' WHEN len(list_intersect(r, ['mention_too_short', 'ambiguous_short_term'])) > 0 THEN 'ambiguous_abbreviation' ELSE 'pathb_abstained' END
WHEN accepted AND linked NOT IN ('', gold) THEN 'false_link' WHEN baseline = gold THEN 'baseline_exact' ELSE 'tokenization_or_cleanup_miss' END AS bucket FROM d) SELECT raw AS kind, bucket, count(*) AS n FROM b GROUP BY 1, 2""")
def mention_buckets(spark, sf):
    c = F.col
    b = V.error_bucket(c("gold"), c("baseline"), c("plain"), c("linked"), c("accepted"), F.split("reasons", ","))
    return _detail(spark, sf).groupBy(c("raw").alias("kind"), b.alias("bucket")).agg(F.count("*").alias("n"))


_LEFT = f"l AS (SELECT accepted AS a, accepted AND linked = gold AS r, pathb_stage = 'path_b_canonical_transparent' AS s FROM ({duck(_DETAIL)}) WHERE coalesce(plain, '') <> gold)"


@query(f"""WITH {_LEFT}, g AS (SELECT 'loose' AS kind, count(*) AS n, count(*) FILTER (a) AS accepted, count(*) FILTER (r) AS recovered FROM l UNION ALL SELECT 'strict', count(*) FILTER (s), count(*) FILTER (a AND s), count(*) FILTER (r AND s) FROM l)
SELECT *, round(coalesce(recovered / nullif(accepted, 0), 0), 6) AS accepted_precision, round(coalesce(recovered / nullif(n, 0), 0), 6) AS recovery_rate, round(coalesce((n - accepted) / nullif(n, 0), 0), 6) AS abstention_rate FROM g""")
def leftover_metrics(spark, sf):
    d = _detail(spark, sf)
    correct = lambda x: F.coalesce(F.col(x), F.lit("")) == F.col("gold")
    return V.leftover_metrics(d.select("pathb_stage", correct("plain").alias("patha_correct"), F.col("accepted").alias("pathb_accepted"), correct("linked").alias("pathb_correct")))


@query(f"SELECT id::VARCHAR AS adjudication_unit_id, pathb_stage, gold AS adjudicated_canonical_label, raw AS current_error_bucket, '' AS mention_status FROM ({duck(_DETAIL)}) WHERE coalesce(plain, '') <> gold AND trim(pathb_stage) <> 'path_a_exact_vocab'")
def strict_slice(spark, sf):
    d = _detail(spark, sf)
    d = d.select(F.col("id").alias("adjudication_unit_id"), "pathb_stage", F.col("gold").alias("gold_canonical"), F.col("raw").alias("error_bucket"), (F.coalesce("plain", F.lit("")) == F.col("gold")).alias("patha_correct"))
    return V.strict_slice(d, ["adjudication_unit_id", "pathb_stage", "adjudicated_canonical_label", "current_error_bucket", "mention_status"])


_ALIASES = f"SELECT alias_raw, canonical, include, CASE length(canonical) % 4 WHEN 0 THEN ' Low' WHEN 1 THEN 'uncertain' ELSE 'high' END AS confidence FROM ({roles.ALIASES}) AS a UNION ALL SELECT p_name || ' 10 mg', p_name, true, CASE length(p_name) % 4 WHEN 0 THEN ' Low' WHEN 1 THEN 'uncertain' ELSE 'high' END FROM {roles.NAMES} UNION ALL SELECT substr(p_name, 1, 3), p_name, length(p_name) % 2 = 0, 'high' FROM {roles.NAMES}"


@query(f"""WITH u AS (SELECT {core._norm('alias_raw')} AS alias, {core._norm('canonical')} AS canonical, lower(trim(confidence)) AS confidence FROM ({duck(_ALIASES)}) WHERE include),
o AS (SELECT *, len(list_intersect(list_distinct(string_split(alias, ' ')), list_distinct(string_split(canonical, ' ')))) AS common FROM u WHERE alias <> '' AND canonical <> '')
SELECT alias, array_to_string(list_sort(list(DISTINCT canonical)), '|') AS canonical, 'non_one_to_one_alias' AS issue FROM u GROUP BY alias HAVING count(DISTINCT canonical) > 1
UNION SELECT alias, canonical, CASE WHEN length(alias) <= 3 THEN 'very_short_alias' WHEN common = 0 THEN 'zero_token_overlap' ELSE 'low_confidence_mapping' END FROM o WHERE length(alias) <= 3 OR common = 0 OR confidence IN ('low', 'uncertain')""")
def alias_lint(spark, sf):
    return V.alias_lint(role(spark, sf, _ALIASES))


@query(f"SELECT id FROM ({duck(_DETAIL)}) WHERE accepted AND (raw <> linked OR length(raw) <= 4 OR margin < 0.08)")
def suspicious_links(spark, sf):
    return _detail(spark, sf).where("accepted").where(V.suspicious(F.col("raw"), F.col("linked"), F.col("margin").cast("double"))).select("id")


_TERMS = f"SELECT mention_id, CASE mention_id % 4 WHEN 0 THEN raw || ' with Iron' WHEN 1 THEN 'sodium ' || gold WHEN 2 THEN ' Lactated ' || gold ELSE gold END AS term FROM ({roles.MENTIONS}) AS m"


@query(rf"""SELECT mention_id, CASE WHEN regexp_matches(lower(term), '/|\+|\bwith\b|\band\b|\bplus\b|\bxr\b|\ber\b|\bir\b|\btablet\b|\bcapsule\b|\bpatch\b') THEN 'Formulation/combo review' WHEN regexp_matches(lower(term), '\b(calcium|sodium|glucose|iron|creatinine|collagen|lactate)\b') THEN 'Substance/non-med review' ELSE 'Alias/vocabulary review' END AS label FROM ({duck(_TERMS)})""")
def follow_up_labels(spark, sf):
    return role(spark, sf, _TERMS).select("mention_id", V.follow_up(F.col("term")).alias("label"))


_ACT = "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN ' Start' WHEN 1 THEN 'hold' WHEN 2 THEN 'STOP' WHEN 3 THEN 'dose_change' WHEN 4 THEN 'none' ELSE NULL END AS action, CASE event_id % 4 WHEN 0 THEN 'toxicity' WHEN 1 THEN 'Cost ' WHEN 2 THEN 'none' ELSE NULL END AS reason FROM {events}"


@query(f"""SELECT id, CASE lower(trim(coalesce(action, ''))) WHEN 'start' THEN 'newly_started' WHEN 'hold' THEN 'held_paused' WHEN 'stop' THEN 'discontinued_stopped' WHEN 'dose_change' THEN 'active_current' ELSE CASE WHEN lower(trim(reason)) IN ('toxicity', 'cost') THEN 'discontinued_stopped' ELSE 'active_current' END END AS hint FROM ({duck(_ACT)})""")
def status_hints(spark, sf):
    return role(spark, sf, _ACT).select("id", V.status_hint(F.col("action"), F.col("reason")).alias("hint"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE lower(p_brand) END AS entity, 'concept_id:' || p_partkey AS id FROM part")
def structured_entities(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    raw = F.when(F.col("p_partkey") % 5 == 0, " NaN").when(F.col("p_partkey") % 5 == 1, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))
    return p.select("p_partkey", V.entity(raw).alias("entity"), V.entity(F.col("p_partkey"), True).alias("id"))


@query("""WITH c AS (SELECT user_id % 97 AS visit_id, CASE WHEN user_id % 97 < 5 THEN NULL ELSE event_type END AS service, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY service IS NULL, n DESC, service) AS r FROM c)
SELECT visit_id, coalesce(service, '<UNKNOWN_SERVICE>') AS service FROM r WHERE r = 1""")
def visit_service(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 97).alias("visit_id"), F.when(F.col("user_id") % 97 >= 5, F.col("event_type")).alias("service"))
    return V.service_mode(e, ["visit_id"])


def _failures(spark, sf) -> DataFrame:
    return core._ladder(spark, sf).where("a4 <> gold").select("raw", "gold", X.failure_category(F.col("raw"), F.col("a2"), F.col("gold")).alias("category"))


_FAIL = core.ORACLES["failure_taxonomy"]
_CATS = ", ".join(f"('{c}')" for c in V.CATEGORIES)


@query(f"WITH f AS ({_FAIL}), c(category) AS (VALUES {_CATS}) SELECT c.category, coalesce(n, 0) AS n, round(100 * coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (), 0), 0), 2) AS percent FROM c LEFT JOIN f ON c.category = f.category")
def failure_table(spark, sf):
    return V.taxonomy_table(_failures(spark, sf))


@query(f"""WITH x AS ({_FAIL.replace("SELECT category, count(*) AS n FROM (SELECT", "SELECT category, raw, gold FROM (SELECT raw, gold,").replace(") GROUP BY category", ")")}), p AS (SELECT category, lower(raw) AS mention, lower(gold) AS gold, count(*) AS n FROM x GROUP BY 1, 2, 3),
g AS (SELECT category, mention, sum(n)::BIGINT AS n, arg_min(gold, (-n, gold)) AS gold FROM p GROUP BY 1, 2) SELECT category, mention, n, gold FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, mention) AS r FROM g) WHERE r <= 8""")
def failure_examples(spark, sf):
    return V.taxonomy_examples(_failures(spark, sf))


@query("SELECT terms, detections, mentions, filled, why AS likely_failure_point FROM (VALUES (0::BIGINT, 5::BIGINT, 5::BIGINT, 5::BIGINT, 'no_ehr_entity_lexicons_loaded'), (11, 0, 0, 0, 'no_raw_medspacy_detections'), (11, 7, 0, 0, 'raw_detections_filtered_or_not_mapped_to_entity_labels'), (11, 7, 3, 0, 'serialization_or_output_contract_issue'), (11, 7, 3, 2, 'none')) AS t(terms, detections, mentions, filled, why)")
def failure_causes(spark, sf):
    return V.failure_cause(spark.createDataFrame([(0, 5, 5, 5), (11, 0, 0, 0), (11, 7, 0, 0), (11, 7, 3, 0), (11, 7, 3, 2)], "terms long, detections long, mentions long, filled long"))


@query("SELECT o_orderkey FROM orders ORDER BY sha1('audit' || o_orderkey), o_orderkey LIMIT 40")
def audit_sample(spark, sf):
    return V.sample(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), "o_orderkey", 40, "audit")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'fallback' ELSE '' END AS value FROM events")
def first_nonblank(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type")).when(F.col("event_id") % 3 == 1, "  ")
    return e.select("event_id", V.first_nonblank(a, F.when(F.col("event_id") % 3 == 1, "fallback ")).alias("value"))


_PAIRS = "SELECT l_orderkey % 900 AS visit_id, 'd' || l_partkey % 40 || 'x' AS note_term, 'd' || l_suppkey % 11 AS ehr_term, l_linenumber AS line FROM {lineitem}"


@query(f"""WITH p AS ({duck(_PAIRS)}), v AS (SELECT visit_id, list_sort(coalesce(list(DISTINCT note_term) FILTER (line = 1), [])) AS a, list_sort(coalesce(list(DISTINCT ehr_term) FILTER (line = 2), [])) AS b FROM p GROUP BY 1)
SELECT visit_id, array_to_string(a, '|') AS note_terms, array_to_string(b, '|') AS ehr_terms FROM v WHERE len(a) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(a) AS x) JOIN (SELECT unnest(b) AS y) ON contains(x, y) OR contains(y, x)) ORDER BY visit_id LIMIT 60""")
def unmatched_visits(spark, sf):
    p = role(spark, sf, _PAIRS)
    terms = lambda c, n: F.array_sort(F.collect_set(F.when(F.col("line") == n, F.col(c))))
    v = p.groupBy("visit_id").agg(terms("note_term", 1).alias("note_terms"), terms("ehr_term", 2).alias("ehr_terms"))
    return V.unmatched_visits(v, 60).select("visit_id", F.array_join("note_terms", "|").alias("note_terms"), F.array_join("ehr_terms", "|").alias("ehr_terms"))


_STOP = ("the", "and", "of", "a")


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')) AS s FROM documents), h AS (SELECT regexp_extract_all(s, '[a-z0-9'']+') AS w FROM s WHERE contains(s, 'license') OR contains(s, 'copyright')),
g AS (SELECT unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS g FROM h)
SELECT array_to_string(g, ' ') AS ngram, count(*) AS n FROM g WHERE g[1] NOT IN {_STOP} AND g[-1] NOT IN {_STOP} GROUP BY 1 HAVING count(*) >= 3""")
def seed_ngrams(spark, sf):
    return V.cooccurring(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", ["license", "copyright"], _STOP)
