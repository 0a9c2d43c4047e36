"""Registered queries over report tables, review templates, code descriptions and lists resolved by visit, each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import reports as P
from noteloom.operators import relational as R
from noteloom.plans import core, roles
from noteloom.plans.evaluation import _DETAIL
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


# structured codes

_ICD = "SELECT p_partkey AS ord, 'C' || (p_partkey % 90 + 10) || '.' || (p_partkey % 7) || ' ' || upper(p_type) AS value FROM {part}"
_CODE = "'C' || (l_partkey % 97 + 10) || '.' || (l_partkey % 9)"
_COND = f"SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 6 WHEN 0 THEN lower({_CODE}) || ' old' WHEN 1 THEN ' ' || {_CODE} WHEN 2 THEN replace({_CODE}, '.', '') WHEN 3 THEN 'Unknown ' || l_returnflag WHEN 4 THEN '  ' ELSE NULL END AS value FROM {{lineitem}}"


@query(f"""WITH m AS (SELECT code, arg_max(text, ord) AS text FROM (SELECT ord, unnest(list_distinct([c, replace(c, '.', '')])) AS code, text FROM (SELECT ord, split_part(value, ' ', 1) AS c, lower(substr(value, strpos(value, ' ') + 1)) AS text FROM ({duck(_ICD)}))) GROUP BY 1),
v AS (SELECT id, trim(coalesce(value, '')) AS t, upper(split_part(trim(coalesce(value, '')), ' ', 1)) AS w FROM ({duck(_COND)}))
SELECT id, coalesce(a.text, b.text, c.text, d.text, lower(t)) AS description FROM v LEFT JOIN m a ON a.code = w LEFT JOIN m b ON b.code = replace(w, '.', '') LEFT JOIN m c ON c.code = upper(t) LEFT JOIN m d ON d.code = replace(upper(t), '.', '')""")
def condition_descriptions(spark, sf):
    return P.describe(role(spark, sf, _COND), "value", P.code_map(role(spark, sf, _ICD)), P.condition_tries()).select("id", "description")


_PCS = "SELECT p_partkey AS ord, lpad(CAST(p_partkey AS STRING), 5, '0') || ' 0B' || lpad(CAST(p_partkey % 900 AS STRING), 5, '0') || ' 1 ' || p_brand || ' short   ' || p_name AS value FROM {part}"
_PROC = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 5 WHEN 0 THEN 'x;0b' || lpad(CAST(l_partkey % 1000 AS STRING), 5, '0') || '/0B00007' WHEN 1 THEN '0B' || lpad(CAST(l_partkey % 1000 AS STRING), 5, '0') || '.' WHEN 2 THEN 'Visit, ' || l_returnflag WHEN 3 THEN '' ELSE NULL END AS value FROM {lineitem}"


@query(rf"""WITH m AS (SELECT code, arg_max(text, ord) AS text FROM (SELECT ord, split_part(value, ' ', 2) AS code, lower(split_part(value, '   ', 2)) AS text FROM ({duck(_PCS)})) GROUP BY 1), v AS (SELECT id, trim(coalesce(value, '')) AS t FROM ({duck(_PROC)})),
l AS (SELECT DISTINCT t, list_concat([upper(t)], string_split_regex(upper(t), '[\s,;|/]+')) AS l FROM v WHERE t <> ''), c AS (SELECT t, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS c FROM l), f AS (SELECT t, arg_min(text, p) AS text FROM c JOIN m ON code = replace(c, '.', '') GROUP BY t)
SELECT v.id, coalesce(f.text, lower(v.t)) AS description FROM v LEFT JOIN f ON v.t = f.t""")
def procedure_descriptions(spark, sf):
    return P.describe(role(spark, sf, _PROC), "value", P.procedure_map(role(spark, sf, _PCS)), P.procedure_tries()).select("id", "description")


_DATES = "SELECT o_custkey AS person_id, o_orderkey AS visit_id, CASE o_orderkey % 5 WHEN 0 THEN 'not a date' WHEN 1 THEN substr(CAST(o_orderdate AS STRING), 1, 10) || ' 10:11:12' WHEN 2 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS written FROM {orders}"


@query(f"SELECT person_id, visit_id, substr(written, 1, 10) AS visit_date, row_number() OVER (PARTITION BY person_id ORDER BY substr(written, 1, 10), visit_id)::INT - 1 AS rank FROM ({duck(_DATES)}) WHERE written LIKE '%-%-%'")
def timeline_dates(spark, sf):
    d = role(spark, sf, _DATES).select("person_id", "visit_id", P.iso_date(F.col("written")).alias("visit_date")).where("visit_date is not null")
    return R.visit_ranks(d, "person_id", "visit_id", "visit_date")


# review

@query(core._LADDER + "SELECT mention_id, raw, a3 AS patha_term, vocab_label <> '' AS patha_exact_vocab_hit, vocab_label AS patha_exact_vocab_label, lower(trim(gold)) AS gold FROM ladder WHERE vocab_label <> lower(trim(gold))")
def alias_leftovers(spark, sf):
    return P.leftovers(core._ladder(spark, sf))


_KEYS = "'u' || event_id AS adjudication_unit_id, user_id AS person_id, event_id % 200 AS visit_id, event_id % 997 AS note_id"
_LEFT = f"SELECT {_KEYS}, event_id % 31 AS span_id_or_local_reference, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS raw_mention_text, 'g' || event_id % 7 AS adjudicated_canonical_label, 'old' AS mention_status, CASE WHEN event_id % 2 = 0 THEN 'own' END AS context_text FROM {{events}}"
_PACKETS = f"SELECT event_id AS ord, {_KEYS}, CASE WHEN event_id % 5 = 0 THEN 99 ELSE event_id % 31 END AS span_id_or_local_reference, 'packet' AS context_text, event_type || ' note' AS note_title FROM {{events}} WHERE event_id % 3 <> 0 UNION ALL SELECT event_id + 100000000, {_KEYS}, event_id % 31, 'later', 'later' FROM {{events}}"
_REVIEWED = f"SELECT event_id AS ord, {_KEYS}, event_id % 31 AS span_id_or_local_reference, 'r ' || event_type AS raw_mention_text, 'review' AS context_text, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'new' || event_id % 5 END AS adjudicated_canonical_label, 'active' AS mention_status, 'yes' AS compare_to_structured_ehr, '' AS reviewer_notes FROM {{events}} WHERE event_id % 7 <> 0"
_EVALUATED = "SELECT event_id AS ord, 'u' || event_id AS adjudication_unit_id, CASE WHEN event_id % 8 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS STRING) END AS pathb_score, event_id % 3 = 1 AS pathb_accepted, event_type AS error_bucket FROM {events} WHERE event_id % 9 <> 0"
_BLANK = ", ".join(f"'' AS {c}" for c in (*(c for c in P.CONTEXT if c not in ("raw_mention_text", "context_text", "note_title")), *(f"current_{c}" for c in ("reviewer_notes", "patha_term", "patha_prediction", "pathb_prediction", "pathb_reason_codes_json", "pathb_top_k_candidates_json")), "reviewer_notes"))
_NOW = {"adjudicated_canonical_label": "coalesce(nullif(r.adjudicated_canonical_label, ''), l.adjudicated_canonical_label)", "mention_status": "coalesce(r.mention_status, l.mention_status)", "compare_to_structured_ehr": "coalesce(r.compare_to_structured_ehr, '')"}
_SAME = " AND ".join(f"l.{c} = {{0}}.{c}" for c in P.IDENTITY)
_FIRST = "(SELECT * FROM ({0}) QUALIFY row_number() OVER (PARTITION BY adjudication_unit_id ORDER BY ord) = 1)"


@query(f"""SELECT {", ".join(f"l.{c}" for c in P.IDENTITY)}, trim(coalesce(nullif(trim(l.raw_mention_text), ''), r.raw_mention_text, '')) AS raw_mention_text, coalesce(l.context_text, p.context_text, r.context_text, '') AS context_text, coalesce(p.note_title, '') AS note_title,
{", ".join(f"{v} AS {c}, {v} AS current_{c}" for c, v in _NOW.items())}, 'keep' AS review_action, coalesce(e.error_bucket, '') AS current_error_bucket, try_cast(e.pathb_score AS DOUBLE) AS current_pathb_score, coalesce(e.pathb_accepted, false) AS current_pathb_accepted, false AS current_patha_correct, NULL::DOUBLE AS current_pathb_margin, NULL::DOUBLE AS current_pathb_calibrated_confidence, {_BLANK}
FROM ({duck(_LEFT)}) AS l LEFT JOIN {_FIRST.format(duck(_PACKETS))} AS p ON {_SAME.format("p")} LEFT JOIN ({duck(_REVIEWED)}) AS r ON {_SAME.format("r")} LEFT JOIN ({duck(_EVALUATED)}) AS e ON l.adjudication_unit_id = e.adjudication_unit_id""")
def review_template(spark, sf):
    return P.review_template(*[role(spark, sf, s) for s in (_LEFT, _PACKETS, _REVIEWED, _EVALUATED)])


_CELL = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '[{{"canonical_label": "' || event_type || ' 10 mg", "score": 0.' || event_id % 97 || '}}, {{"canonical_label": "", "score": 0.1}}, {{"canonical_label": "Second Name"}}]' WHEN 1 THEN '[]' WHEN 2 THEN 'not json' WHEN 3 THEN '[{{"canonical_label": "Only One", "score": "high"}}]' ELSE NULL END AS cell FROM {events}"""


@query(f"""WITH c AS (SELECT id, CASE WHEN json_valid(cell) THEN cell END AS cell FROM ({duck(_CELL)})), u AS (SELECT id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS l FROM (SELECT id, json_extract_string(cell, '$[*].canonical_label') AS l FROM c)),
g AS (SELECT id, array_to_string(list(n ORDER BY p) FILTER (n <> ''), '|') AS labels FROM (SELECT id, p, {core._norm('l')} AS n FROM u) GROUP BY id) SELECT c.id, coalesce(try_cast(json_extract_string(cell, '$[0].score') AS DOUBLE), 0) AS score, coalesce(labels, '') AS labels FROM c LEFT JOIN g ON c.id = g.id""")
def candidate_cells(spark, sf):
    return role(spark, sf, _CELL).select("id", P.top_score(F.col("cell")).alias("score"), F.array_join(P.top_labels(F.col("cell")), "|").alias("labels"))


# report tables

_SURE = f"SELECT *, (id % 89) / 100.0 AS confidence, (id % 53) / 100.0 AS score FROM ({_DETAIL}) AS d"


def _audit_sql(accepted: bool) -> str:
    return f"SELECT id, raw, linked FROM (SELECT * FROM ({duck(_SURE)}) WHERE {'' if accepted else 'NOT '}accepted ORDER BY confidence DESC, score DESC, id LIMIT 50)"


@query(_audit_sql(True))
def accepted_audit(spark, sf):
    return P.link_audit(role(spark, sf, _SURE), True).select("id", "raw", "linked")


@query(_audit_sql(False))
def rejected_audit(spark, sf):
    return P.link_audit(role(spark, sf, _SURE), False).select("id", "raw", "linked")


@query(f"SELECT raw, count(*) AS n FROM (SELECT raw || '-' || id % 37 AS raw FROM ({duck(_DETAIL)}) WHERE NOT accepted) GROUP BY 1 ORDER BY n DESC, raw LIMIT 25")
def abstained_terms(spark, sf):
    return P.top_counts(role(spark, sf, _DETAIL).where("not accepted").select(F.expr("raw || '-' || id % 37").alias("raw")), "raw")


@query(f"SELECT reasons, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({duck(_DETAIL)}) GROUP BY 1")
def reason_shares(spark, sf):
    return P.shares(role(spark, sf, _DETAIL), "reasons")


_STATUS = "SELECT CASE event_id % 4 WHEN 0 THEN ' Active' WHEN 1 THEN 'HELD' WHEN 2 THEN NULL ELSE 'stopped' END AS mention_status, CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS compare FROM {events}"


@query(f"SELECT 'mention_status' AS \"table\", lower(trim(coalesce(mention_status, ''))) AS value, count(*) AS n FROM ({duck(_STATUS)}) GROUP BY 2 UNION ALL SELECT 'compare', lower(compare), count(*) FROM ({duck(_STATUS)}) GROUP BY 2")
def status_counts(spark, sf):
    return P.status_counts(role(spark, sf, _STATUS), ["mention_status", "compare"])


@query(f"SELECT mention_status AS status, lower(compare) AS compare, count(*) AS n FROM ({duck(_STATUS)}) WHERE compare <> 'Yes' GROUP BY 1, 2")
def structured_gap(spark, sf):
    return P.structured_gap(role(spark, sf, _STATUS).withColumnRenamed("mention_status", "status"))


@query(f"""WITH x AS (SELECT avg((baseline = gold)::INT) AS a, avg((coalesce(plain, '') = gold)::INT) AS b, avg((linked = gold)::INT) AS c, avg((NOT accepted)::INT) AS d, count(*) FILTER (accepted AND linked = gold) / count(*) FILTER (accepted) AS e FROM ({duck(_DETAIL)}))
SELECT 0 AS step, 'baseline' AS method, round(a, 6) AS accuracy, NULL::DOUBLE AS delta, NULL::DOUBLE AS abstention, NULL::DOUBLE AS precision FROM x UNION ALL SELECT 1, 'path_a', round(b, 6), round(b - a, 6), NULL, NULL FROM x UNION ALL SELECT 2, 'path_b', round(c, 6), round(c - b, 6), round(d, 6), round(e, 6) FROM x""")
def accuracy_table(spark, sf):
    names = {"baseline": "baseline", "plain": "path_a", "linked": "path_b"}
    right = [(F.coalesce(c, F.lit("")) == F.col("gold")).alias(n + "_correct") for c, n in names.items()]
    return P.accuracy_steps(role(spark, sf, _DETAIL).select("accepted", *right))


_METRICS = "SELECT CASE event_id % 4 WHEN 0 THEN 'candidate_density_bin' WHEN 1 THEN 'note_length_bin' WHEN 2 THEN 'note_title_norm' ELSE 'service' END AS slice_name, CASE event_id % 11 WHEN 0 THEN '2_3' WHEN 1 THEN '8_plus' WHEN 2 THEN 'lt_250' WHEN 3 THEN 'ge_1500' WHEN 4 THEN 'Consults' WHEN 5 THEN 'Assessment & Plan Note' WHEN 6 THEN '' WHEN 7 THEN 'H&P' ELSE 'other' END AS slice_value, event_id AS tp, event_id % 5 AS fp, event_id % 7 AS fn, CAST(event_id % 1000 AS DOUBLE) / 7000 AS precision, CAST(event_id % 999 AS DOUBLE) / 7000 AS recall, CAST(event_id % 998 AS DOUBLE) / 7000 AS f1 FROM {events}"


@query(f"""SELECT CASE slice_name WHEN 'candidate_density_bin' THEN 'Candidate density' WHEN 'note_length_bin' THEN 'Note length' ELSE 'Note title' END AS slice_family, CASE WHEN slice_name = 'candidate_density_bin' AND slice_value = '2_3' THEN '2-3' WHEN slice_name = 'candidate_density_bin' AND slice_value = '8_plus' THEN '8+' WHEN slice_name = 'note_length_bin' AND slice_value = 'lt_250' THEN '<250' WHEN slice_name = 'note_length_bin' AND slice_value = 'ge_1500' THEN '>=1500' WHEN slice_name = 'note_title_norm' AND slice_value LIKE 'Assess%' THEN 'A&P Note' ELSE slice_value END AS slice_value,
tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM ({duck(_METRICS)}) WHERE (slice_name LIKE '%_bin' AND slice_value <> '') OR (slice_name = 'note_title_norm' AND slice_value IN ('Consults', 'Assessment & Plan Note', 'H&P'))""")
def slice_report(spark, sf):
    return P.pretty_slices(role(spark, sf, _METRICS))


_MEASURED = "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'path_a' ELSE 'path_ab' END AS method, l_partkey % 4 AS note_n, l_discount AS containment_relaxed, l_suppkey % 2 AS has_overlap_relaxed FROM {lineitem}"


@query(f"SELECT method, count(*) AS n, round(100 * avg(containment_relaxed), 4) AS containment_relaxed, round(100 * avg(has_overlap_relaxed), 4) AS has_overlap_relaxed FROM ({duck(_MEASURED)}) WHERE note_n > 0 GROUP BY 1")
def nonempty_metrics(spark, sf):
    return P.nonempty_metrics(role(spark, sf, _MEASURED))


_LINKS = f"SELECT floor(id / 3) AS row, accepted, score, CASE WHEN id % 5 <> 0 THEN score END AS confidence FROM ({roles.SCORES}) AS s"


@query(f"WITH l AS ({duck(_LINKS)}), a AS (SELECT coalesce(confidence, score)::DOUBLE AS c FROM l WHERE accepted), n AS (SELECT count(DISTINCT row) AS n_rows FROM l) SELECT any_value(n_rows) AS n_rows, round(count(*) / any_value(n_rows), 6) AS accept_rate, round(count(*) FILTER (c < 0.9) / count(*), 6) AS low_conf_accept_rate, round(avg(c), 6) AS mean_accept_conf FROM a, n")
def link_guardrails(spark, sf):
    return P.guardrails(role(spark, sf, _LINKS))


_TERMS, _FOUND = "SELECT p_brand AS category, p_type AS term FROM {part}", "SELECT p_brand AS category, l_orderkey AS note_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_brand <> 'Brand#11'"


@query(f"WITH t AS (SELECT category, count(DISTINCT term) AS terms FROM ({duck(_TERMS)}) GROUP BY 1), f AS (SELECT category, count(*) AS d, count(DISTINCT note_id) AS n FROM ({duck(_FOUND)}) GROUP BY 1) SELECT t.category, terms, coalesce(d, 0) AS detections, coalesce(n, 0) AS notes FROM t LEFT JOIN f ON t.category = f.category")
def lexicon_summary(spark, sf):
    return P.lexicon_summary(role(spark, sf, _TERMS), role(spark, sf, _FOUND))


# resolved lists

_PART = "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
_NOTE = f"SELECT l_orderkey AS visit_id, CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 3) || substr(p_name, 5) ELSE 'zz ' || p_brand END AS term {_PART}"
_OWN = f"SELECT l_orderkey AS visit_id, p_name AS term {_PART} WHERE l_linenumber > 1 UNION ALL SELECT l_orderkey AS visit_id, '' AS term {_PART}"


@query(f"""WITH n AS (SELECT DISTINCT visit_id, term FROM ({duck(_NOTE)}) WHERE term <> ''), c AS (SELECT DISTINCT visit_id, term AS label FROM ({duck(_OWN)}) WHERE term <> ''), k AS (SELECT visit_id, count(*) AS total FROM c GROUP BY 1),
cg AS (SELECT visit_id, label, g, count(*) AS tf FROM (SELECT visit_id, label, unnest({core._GRAMS}) AS g FROM (SELECT visit_id, label, ' ' || label || ' ' AS p FROM c)) GROUP BY 1, 2, 3), idf AS (SELECT cg.visit_id, g, ln((1 + any_value(total)) / (1 + count(*))) + 1 AS idf FROM cg JOIN k ON cg.visit_id = k.visit_id GROUP BY 1, 2),
cw AS (SELECT cg.visit_id, label, cg.g, tf * idf AS w FROM cg JOIN idf ON cg.visit_id = idf.visit_id AND cg.g = idf.g), cn AS (SELECT visit_id, label, sqrt(sum(w * w)) AS cn FROM cw GROUP BY 1, 2),
mg AS (SELECT visit_id, term, g, count(*) AS tf FROM (SELECT visit_id, term, unnest({core._GRAMS}) AS g FROM (SELECT visit_id, term, ' ' || term || ' ' AS p FROM n)) GROUP BY 1, 2, 3), mw AS (SELECT mg.visit_id, term, mg.g, tf * coalesce(idf, 1) AS w FROM mg LEFT JOIN idf ON mg.visit_id = idf.visit_id AND mg.g = idf.g), mn AS (SELECT visit_id, term, sqrt(sum(w * w)) AS mn FROM mw GROUP BY 1, 2),
d AS (SELECT mw.visit_id, term, label, sum(mw.w * cw.w) AS dot FROM mw JOIN cw ON mw.visit_id = cw.visit_id AND mw.g = cw.g GROUP BY 1, 2, 3), s AS (SELECT d.visit_id, d.term, d.label, round(dot / (mn * cn), 9) AS score FROM d JOIN mn ON d.visit_id = mn.visit_id AND d.term = mn.term JOIN cn ON d.visit_id = cn.visit_id AND d.label = cn.label),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY visit_id, term ORDER BY score DESC, label) = 1),
r AS (SELECT n.visit_id, n.term, CASE WHEN c.label IS NOT NULL THEN 'path_a' WHEN total IS NULL THEN 'path_a_unresolved' ELSE 'path_b_embedding_cpu' END AS stage, coalesce(c.label, b.label, '') AS linked_to, CASE WHEN c.label IS NOT NULL THEN 1 ELSE coalesce(b.score, 0) END AS score FROM n LEFT JOIN c ON n.visit_id = c.visit_id AND n.term = c.label LEFT JOIN k ON n.visit_id = k.visit_id LEFT JOIN b ON n.visit_id = b.visit_id AND n.term = b.term)
SELECT visit_id, term, stage, linked_to, linked_to <> '' AND score >= 0.3 AS accepted, CASE WHEN linked_to <> '' AND score >= 0.3 THEN linked_to ELSE term END AS mapped FROM r""")
def visit_resolver(spark, sf):
    return P.resolve_lists(role(spark, sf, _NOTE), role(spark, sf, _OWN), 0.3).drop("score")


@query()
def canonical_lists(spark, sf):
    vocab = role(spark, sf, roles.VOCAB).select("canonical", F.array("syn").alias("synonyms"))
    notes = role(spark, sf, roles.MENTIONS).select((F.col("mention_id") % 500).alias("visit_id"), F.col("raw").alias("term"))
    return P.resolve_canonical(notes, role(spark, sf, roles.ALIASES), vocab).select("visit_id", F.array_join("mapped", "|").alias("mapped"))


@query()
def normalization_detail(spark, sf):
    vocab = role(spark, sf, roles.VOCAB).select("canonical", F.array("syn").alias("synonyms"))
    d = P.normalization_detail(role(spark, sf, roles.MENTIONS).withColumn("status", F.lit("active_current")), role(spark, sf, roles.ALIASES), vocab)
    return d.select("mention_id", "gold", "baseline", "path_a", "path_b", "accepted", "baseline_correct", "path_a_correct", "path_b_correct", "error_bucket")
