"""Registered queries over spans, visits and review packets, each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators import resolution as P
from noteloom.plans import roles
from noteloom.plans.roles import duck, role

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


LEXICON = {
    "actions": {"start": ("started on", "initiated"), "stop": ("discontinue", "stopped"), "hold": ("on hold",), "dose_change": ("dose reduced",)},
    "reasons": {"toxicity": ("toxicity", "neuropathy"), "progression": ("progression", "disease progression")},
    "entities": {"conditions": ("nausea", "neuropathy"), "drugs": ("carboplatin", "paclitaxel", "nab-paclitaxel", "lapatinib", "iron"), "measurements": ("hemoglobin",), "procedures": ("ct scan",)},
}
_DRUG = "CASE event_id % 5 WHEN 0 THEN 'Carboplatin' WHEN 1 THEN 'paclitaxel' WHEN 2 THEN 'nab-paclitaxel' WHEN 3 THEN 'lapatinib' ELSE 'iron' END"
_SPANS = f"""SELECT event_id AS ord, CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id % 83 END AS person_id, event_id % 331 AS visit_id, event_id % 1201 AS note_id, event_type AS category, event_type AS note_title, CASE event_id % 12
WHEN 0 THEN 'Patient started on ' || {_DRUG} || ' today.' WHEN 1 THEN 'Plan: discontinue ' || {_DRUG} || ' due to toxicity' WHEN 2 THEN 'No evidence of progression; ' || {_DRUG} || ' on hold' WHEN 3 THEN 'Possible neuropathy, dose reduced for ' || {_DRUG}
WHEN 4 THEN 'He continued ' || {_DRUG} || ' and iron, ironically' WHEN 5 THEN 'Denies pain. Tolerates ' || {_DRUG} || ' with NAUSEA' WHEN 6 THEN 'CT scan showed stable disease' WHEN 7 THEN 'd/c ' || {_DRUG} || ' after disease progression'
WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN 'Hemoglobin was low, ' || {_DRUG} || ' held' ELSE 'Seen in clinic without new complaints' END AS span_text FROM {{events}}"""


def _any(terms) -> str:
    return "\\b(?:" + "|".join(sorted(terms, key=len, reverse=True)) + ")\\b"


_ALL = _any([t for g in LEXICON.values() for ts in g.values() for t in ts])
_RESOLVED = f"""spans AS ({duck(_SPANS)}), low AS (SELECT *, lower(coalesce(span_text, '')) AS t FROM spans),
acts AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(t, '{_any(v)}') THEN '{k}'" for k, v in LEXICON['actions'].items())}
WHEN regexp_matches(t, 'started|initiated|began|prescribed|continue|resume') THEN 'start' WHEN regexp_matches(t, 'stopped|discontinued|ceased|d/c|dc''d') THEN 'stop' WHEN regexp_matches(t, 'hold|held|paused') THEN 'hold' WHEN regexp_matches(t, 'increased|decreased|reduced|adjusted') THEN 'dose_change' ELSE 'none' END AS action,
CASE {' '.join(f"WHEN regexp_matches(t, '{_any(v)}') THEN '{k}'" for k, v in LEXICON['reasons'].items())} ELSE 'none' END AS reason FROM low),
res AS (SELECT *, CASE WHEN len(list_filter(string_split(replace(t, '. ', chr(1)), chr(1)), lambda s: regexp_matches(s, '\\b(?:not|no|denies|without|possible|maybe|possibly)\\b.*{_ALL}'))) > 0 THEN 'low' WHEN action <> 'none' OR reason <> 'none' THEN 'high' ELSE 'low' END AS certainty,
{', '.join(f"list_sort(list_distinct(regexp_extract_all(t, '{_any(v)}'))) AS {d}" for d, v in LEXICON['entities'].items())} FROM acts)"""


def _spans(spark, sf) -> DataFrame:
    return role(spark, sf, _SPANS)


def _resolved(spark, sf) -> DataFrame:
    return P.resolve_spans(_spans(spark, sf), LEXICON)


def _joined(*cols: str) -> list:
    return [F.array_join(c, "|").alias(c) for c in cols]


_J = ", ".join(f"array_to_string({d}, '|') AS {d}" for d in P.DOMAINS)


@query(f"WITH {_RESOLVED} SELECT ord, action AS treatment_action, reason AS discontinuation_reason, certainty, {_J} FROM res")
def span_entities(spark, sf):
    return _resolved(spark, sf).select("ord", "treatment_action", "discontinuation_reason", "certainty", *_joined(*P.DOMAINS))


_V = ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(flatten(list({d})))), '|'), '') AS {d}" for d in P.DOMAINS)


@query(f"""WITH {_RESOLVED} SELECT person_id, visit_id, count(*) AS n_spans, count(DISTINCT note_id) AS n_notes, {_V},
coalesce(array_to_string(list_sort(list(DISTINCT action) FILTER (action <> 'none')), '|'), '') AS treatment_actions, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason <> 'none')), '|'), '') AS discontinuation_reasons FROM res WHERE certainty = 'high' GROUP BY 1, 2""")
def visit_entities(spark, sf):
    g = P.visit_entities(_resolved(spark, sf), certain_only=True)
    return g.select("person_id", "visit_id", "n_spans", "n_notes", *_joined(*P.DOMAINS, "treatment_actions", "discontinuation_reasons"))


_SEED = f"""{_RESOLVED}, keyed AS (SELECT *, coalesce(person_id::VARCHAR, '') AS p, visit_id::VARCHAR AS v, note_id::VARCHAR AS n, trim(coalesce(span_text, '')) AS x FROM res WHERE ord % 9 <> 4),
drugs_of AS (SELECT p, v, n, category, x, d, min((ord, i)) AS pos FROM (SELECT p, v, n, category, x, ord, unnest(drugs) AS d, generate_subscripts(drugs, 1) AS i FROM keyed) GROUP BY ALL),
seed AS (SELECT k.p, k.v, k.n, k.category, k.x, coalesce(first(l.ds), []) AS ds, arg_min(action, ord) AS action, arg_min(reason, ord) AS reason, arg_min(certainty, ord) AS certainty FROM keyed k LEFT JOIN (SELECT p, v, n, category, x, list(d ORDER BY pos) AS ds FROM drugs_of GROUP BY ALL) l ON k.p = l.p AND k.v = l.v AND k.n = l.n AND k.category = l.category AND k.x = l.x GROUP BY k.p, k.v, k.n, k.category, k.x),
cand AS (SELECT ord, coalesce(person_id::VARCHAR, '') AS p, visit_id::VARCHAR AS v, note_id::VARCHAR AS n, category, trim(coalesce(span_text, '')) AS x FROM spans),
met AS (SELECT c.*, coalesce(ds, []) AS ds, coalesce(action, '') AS action, coalesce(reason, '') AS reason, coalesce(certainty, '') AS certainty FROM cand c LEFT JOIN seed s ON c.p = s.p AND c.v = s.v AND c.n = s.n AND c.category = s.category AND c.x = s.x),
ment AS (SELECT m.*, d, i - 1 AS i FROM (SELECT ord, unnest(CASE WHEN len(ds) = 0 THEN [NULL] ELSE ds END) AS d, generate_subscripts(CASE WHEN len(ds) = 0 THEN [NULL] ELSE ds END, 1) AS i FROM met) e JOIN met m ON e.ord = m.ord)"""


def _mentions(spark, sf) -> DataFrame:
    seeds = P.seed_lookup(_resolved(spark, sf).where("ord % 9 <> 4"), "ord")  # some candidates have no seed
    return P.mention_packets(_spans(spark, sf), seeds, "ord")


@query(f"""WITH {_SEED} SELECT 'adj_' || substr(sha1(p || '||' || v || '||' || n || '||' || ord || '||' || CASE WHEN d IS NULL THEN 'no_seed' ELSE d || '||' || i END), 1, 16) AS unit_id, p AS person_id, v AS visit_id, n AS note_id, ord AS span_id, coalesce(d, '') AS raw_mention, x AS context, category AS candidate_category, len(ds)::INT AS n_seed_drugs, action AS seed_treatment_action, reason AS seed_discontinuation_reason, certainty AS seed_certainty FROM ment""")
def mention_packets(spark, sf):
    return _mentions(spark, sf)


_NOTEPKT = f"""spans AS ({duck(_SPANS)}), notes AS ({duck(roles.NOTES)}), r AS (SELECT *, row_number() OVER (PARTITION BY person_id, visit_id, note_id ORDER BY ord) AS k FROM spans),
g AS (SELECT person_id, visit_id, note_id, count(*) AS span_count, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories, array_to_string(list(coalesce(span_text, '') ORDER BY k) FILTER (k <= 5), '|') AS span_examples, arg_min(note_title, k) AS title FROM r GROUP BY 1, 2, 3),
pkt AS (SELECT 'notepkt_' || substr(sha1(coalesce(g.person_id::VARCHAR, '') || '||' || g.visit_id || '||' || g.note_id), 1, 16) AS packet_note_id, g.person_id, g.visit_id, g.note_id::VARCHAR AS note_id, coalesce(n.note_title, title, '') AS note_title, span_count, categories, span_examples, md5(substr(coalesce(note_text, ''), 1, 2000)) AS excerpt_md5, (n.note_id IS NOT NULL)::INT AS note_found, (length(trim(coalesce(note_text, ''), ' ')) > 0)::INT AS text_attached FROM g LEFT JOIN notes n ON g.note_id = n.note_id)"""


def _note_packets(spark, sf) -> DataFrame:
    return P.note_packets(_spans(spark, sf), role(spark, sf, roles.NOTES), "ord")


@query(f"WITH {_NOTEPKT} SELECT * FROM pkt")
def note_packets(spark, sf):
    return _note_packets(spark, sf).withColumn("excerpt_md5", F.md5("excerpt")).drop("excerpt").withColumn("categories", F.array_join("categories", "|")).withColumn("span_examples", F.array_join("span_examples", "|"))


@query(f"""WITH {_SEED}, {_NOTEPKT.removeprefix(f"spans AS ({duck(_SPANS)}), ")}, a AS (SELECT count(*) AS mentions, count(DISTINCT n) AS notes, count(DISTINCT (p, v)) AS visits, avg((length(x) > 0)::INT) AS present_rate, avg((length(x) >= 20)::INT) AS sufficient_rate FROM ment),
b AS (SELECT count(*) AS packets, sum(note_found)::BIGINT AS found, sum(text_attached)::BIGINT AS attached FROM pkt) SELECT *, attached / packets AS attached_rate, coalesce(attached / nullif(found, 0), 0) AS attached_when_found FROM a, b""")
def packet_quality(spark, sf):
    return P.packet_quality(_mentions(spark, sf), _note_packets(spark, sf))


@query(f"""WITH spans AS ({duck(_SPANS)}), notes AS ({duck(roles.NOTES)}), a AS (SELECT s.category, n.note_text AS full_text FROM spans s LEFT JOIN notes n ON s.note_id = n.note_id)
SELECT category, count(*) AS n, avg((full_text IS NOT NULL)::INT) AS match_rate, coalesce(sum(length(full_text)), 0)::BIGINT AS chars FROM a GROUP BY 1""")
def attached_text(spark, sf):
    a = P.attach_text(_spans(spark, sf), role(spark, sf, roles.NOTES), "note_id")
    return a.groupBy("category").agg(F.count("*").alias("n"), F.avg(F.col("full_text").isNotNull().cast("double")).alias("match_rate"), F.coalesce(F.sum(F.length("full_text")), F.lit(0)).alias("chars"))


_COHORT = f"""notes AS ({duck(roles.NOTES)}), stats AS (SELECT person_id, visit_id, count(*) AS n_spans, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories FROM ({duck(_SPANS)}) GROUP BY 1, 2),
visits AS (SELECT person_id, visit_id, count(*) AS n_notes, count(*) FILTER (note_title IN ('src0', 'src1')) AS clinic FROM notes GROUP BY 1, 2),
drugs AS (SELECT DISTINCT o_orderkey % 331 AS visit_id FROM orders WHERE o_totalprice > 400000),
full_ AS (SELECT v.person_id, v.visit_id, n_notes, clinic, coalesce(n_spans, 0) AS n_spans, coalesce(categories, '') AS categories, d.visit_id IS NOT NULL AS has_drugs FROM visits v LEFT JOIN stats s ON v.person_id = s.person_id AND v.visit_id = s.visit_id LEFT JOIN drugs d ON v.visit_id = d.visit_id)"""


def _cohort(spark, sf) -> DataFrame:
    notes, spans = role(spark, sf, roles.NOTES), _spans(spark, sf)
    visits = notes.groupBy("person_id", "visit_id").agg(F.count("*").alias("n_notes"), F.count_if(F.col("note_title").isin("src0", "src1")).alias("clinic"))
    stats = spans.groupBy("person_id", "visit_id").agg(F.count("*").alias("n_spans"), F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))
    drugs = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 400000").select((F.col("o_orderkey") % 331).alias("visit_id")).distinct().withColumn("has_drugs", F.lit(True))
    return visits.join(stats, ["person_id", "visit_id"], "left").join(drugs, "visit_id", "left").fillna({"n_spans": 0, "categories": "", "has_drugs": False})


@query(f"WITH {_COHORT} SELECT * FROM full_")
def cohort_visits(spark, sf):
    return _cohort(spark, sf).select("person_id", "visit_id", "n_notes", "clinic", "n_spans", "categories", "has_drugs")


@query(f"WITH {_COHORT} SELECT count(*) AS visits, count(DISTINCT person_id) AS persons, count(*) FILTER (has_drugs) AS with_drugs, count(*) FILTER (n_spans > 0) AS with_spans, sum(clinic)::BIGINT AS clinic_notes, sum(n_notes - clinic)::BIGINT AS other_notes FROM full_")
def cohort_summary(spark, sf):
    return _cohort(spark, sf).agg(F.count("*").alias("visits"), F.countDistinct("person_id").alias("persons"), F.count_if("has_drugs").alias("with_drugs"), F.count_if(F.col("n_spans") > 0).alias("with_spans"), F.sum("clinic").alias("clinic_notes"), F.sum(F.col("n_notes") - F.col("clinic")).alias("other_notes"))


@query(f"WITH notes AS ({duck(roles.NOTES)}), k AS (SELECT DISTINCT person_id, visit_id FROM ({duck(_SPANS)}) WHERE category = 'click' OR visit_id < 40) SELECT note_id, n.person_id, n.visit_id FROM notes n JOIN k ON n.person_id = k.person_id AND n.visit_id = k.visit_id")
def notes_of_visits(spark, sf):
    keys = _spans(spark, sf).where("category = 'click' or visit_id < 40")
    return P.restrict(role(spark, sf, roles.NOTES), keys, ["person_id", "visit_id"]).select("note_id", "person_id", "visit_id")


@query(f"WITH s AS ({duck(_SPANS)}), k AS (SELECT DISTINCT person_id, visit_id FROM s WHERE person_id IS NOT NULL ORDER BY 1, 2 LIMIT 50) SELECT s.ord, s.person_id, s.visit_id FROM s JOIN k ON s.person_id = k.person_id AND s.visit_id = k.visit_id")
def visit_cap(spark, sf):
    return P.first_keys(_spans(spark, sf).where("person_id is not null"), ["person_id", "visit_id"], 50).select("ord", "person_id", "visit_id")


@query(f"SELECT ord, person_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY note_id, ord) AS r FROM ({duck(_SPANS)}) WHERE length(trim(coalesce(span_text, ''))) >= 20) WHERE r <= 7")
def candidate_cap(spark, sf):
    return P.cap_in_order(_spans(spark, sf).where("length(trim(coalesce(span_text, ''))) >= 20"), "person_id", ["note_id", "ord"], 7).select("ord", "person_id")


@query(f"""WITH v AS (SELECT DISTINCT person_id, CASE WHEN visit_id % 7 = 0 THEN 'v' || visit_id ELSE visit_id::VARCHAR END AS visit_id FROM ({duck(_SPANS)}))
SELECT person_id, visit_id, rank, DATE '2000-01-01' + rank::INT AS day FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY try_cast(visit_id AS DOUBLE) NULLS LAST, visit_id) AS rank FROM v)""")
def pseudo_timeline(spark, sf):
    v = _spans(spark, sf).withColumn("visit_id", F.when(F.col("visit_id") % 7 == 0, F.concat(F.lit("v"), "visit_id")).otherwise(F.col("visit_id").cast("string")))
    return P.pseudo_timeline(v)


_PRED = "SELECT event_id, event_id % 331 AS visit_id, event_type AS status, event_id % 3 = 0 AS accepted, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'd' || event_id % 13 END AS linked, 'd' || event_id % 17 AS plain, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'd' || event_id % 11 END AS surface FROM {events}"
_GOLD = "SELECT l_orderkey % 331 AS visit_id, 'd' || l_partkey % 19 AS drug FROM {lineitem}"


@query(f"""WITH p AS (SELECT *, CASE WHEN accepted AND linked <> '' THEN linked ELSE plain END AS layered FROM ({duck(_PRED)})), gold AS (SELECT visit_id, list(DISTINCT drug) AS truth FROM ({duck(_GOLD)}) GROUP BY 1),
long AS (SELECT visit_id, status, unnest(['surface', 'plain', 'layered']) AS method, unnest([surface, plain, layered]) AS value FROM p),
each AS (SELECT visit_id, method, value, 'all' AS status FROM long UNION ALL SELECT visit_id, method, value, status FROM long),
g AS (SELECT visit_id, method, status, coalesce(list(DISTINCT value) FILTER (value <> ''), []) AS vals FROM each GROUP BY 1, 2, 3), m AS (SELECT g.*, len(list_intersect(vals, truth)) AS common, len(truth) AS n FROM g JOIN gold USING (visit_id))
SELECT method, status, count(*) AS visits, avg((common > 0)::INT) AS overlap_rate, avg(common / n) AS containment FROM m GROUP BY 1, 2""")
def method_ablation(spark, sf):
    gold = role(spark, sf, _GOLD).groupBy("visit_id").agg(F.collect_set("drug").alias("truth"))
    methods = {"surface": F.col("surface"), "plain": F.col("plain"), "layered": P.layered(F.col("accepted"), F.col("linked"), F.col("plain"))}
    return P.ablation(role(spark, sf, _PRED), methods, ["visit_id"], gold, "status")


@query(f"""WITH g AS (SELECT visit_id, list_sort(coalesce(list(DISTINCT linked) FILTER (linked <> ''), [])) AS x, list_sort(coalesce(list(DISTINCT surface) FILTER (surface <> ''), [])) AS y FROM ({duck(_PRED)}) GROUP BY 1)
SELECT count(*) AS visits, avg((x = y)::INT) AS equal_rate, avg(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0)) AS jaccard, avg(len(x)) AS mean_x, median(len(x)) AS median_x, avg(len(y)) AS mean_y, median(len(y)) AS median_y FROM g""")
def set_sensitivity(spark, sf):
    return P.set_sensitivity(role(spark, sf, _PRED), ["visit_id"], "linked", "surface")


@query(f"SELECT CASE WHEN linked = '' THEN '<EMPTY>' ELSE linked END AS value, count(*) AS n FROM ({duck(_PRED)}) GROUP BY 1")
def value_counts(spark, sf):
    return P.value_counts(role(spark, sf, _PRED), "linked")


@query(f"SELECT CASE WHEN surface = '' THEN '<EMPTY>' ELSE surface END AS value, count(*) AS n FROM ({duck(_PRED)}) GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_values(spark, sf):
    return P.value_counts(role(spark, sf, _PRED), "surface", 5)


@query("""WITH p AS (SELECT p_partkey, p_name AS a, p_type || ' ' || split_part(p_name, ' ', 1) AS b FROM part), t AS (SELECT p_partkey, list_distinct(string_split(lower(a), ' ')) AS x, list_distinct(string_split(lower(b), ' ')) AS y FROM p)
SELECT p_partkey, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS ratio FROM t""")
def overlap_ratios(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", P.overlap_ratio(F.col("p_name"), F.concat_ws(" ", "p_type", F.split("p_name", " ")[0])).alias("ratio"))


@query(f"""WITH s AS ({duck(roles.SCORES)}), b AS (SELECT floor(score * 10) / 10 AS band, count(*) FILTER (accepted) AS n, coalesce(count(*) FILTER (accepted AND correct) / nullif(count(*) FILTER (accepted), 0), 0) AS precision FROM s GROUP BY 1) SELECT * FROM b WHERE n > 0 AND precision >= 0.75 ORDER BY band LIMIT 1""")
def operating_point(spark, sf):
    s = role(spark, sf, roles.SCORES).groupBy((F.floor(F.col("score").cast("double") * 10) / 10).alias("band"))
    b = s.agg(F.count_if("accepted").alias("n"), F.coalesce(F.try_divide(F.count_if(F.col("accepted") & F.col("correct")), F.count_if("accepted")), F.lit(0.0)).alias("precision"))
    return P.operating_point(b, 0.75)


_STEPS = (("spans", "true"), ("text", "length(trim(coalesce(span_text, ''))) > 0"), ("long enough", "length(trim(span_text)) >= 20"), ("action", "treatment_action <> 'none'"), ("certain", "certainty = 'high'"), ("drug", "size(drugs) > 0"))


@query(f"""WITH {_RESOLVED}, c AS (SELECT count(*) AS a, count(*) FILTER (length(trim(t)) > 0) AS b, count(*) FILTER (length(trim(t)) >= 20) AS c, count(*) FILTER (length(trim(t)) >= 20 AND action <> 'none') AS d, count(*) FILTER (length(trim(t)) >= 20 AND action <> 'none' AND certainty = 'high') AS e, count(*) FILTER (length(trim(t)) >= 20 AND action <> 'none' AND certainty = 'high' AND len(drugs) > 0) AS f FROM res)
SELECT unnest([0, 1, 2, 3, 4, 5, 6])::INT AS step, unnest(['all', 'spans', 'text', 'long enough', 'action', 'certain', 'drug']) AS name, unnest([a, a, b, c, d, e, f]) AS n FROM c""")
def transition_funnel(spark, sf):
    from noteloom.operators.relational import funnel

    return funnel(_resolved(spark, sf), [(n, F.expr(c)) for n, c in _STEPS])


@query(f"SELECT DISTINCT visit_id FROM (SELECT visit_id FROM ({duck(_SPANS)}) UNION ALL SELECT visit_id FROM ({duck(roles.NOTES)}))")
def all_visits(spark, sf):
    return _spans(spark, sf).select("visit_id").unionByName(role(spark, sf, roles.NOTES).select("visit_id")).distinct()
