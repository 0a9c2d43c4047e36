"""Registered queries over the linker, the greedy assignment, and truth and term tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.functions import text as X
from noteloom.operators import linking as L
from noteloom.operators import relational as R
from noteloom.plans import roles
from noteloom.plans.core import _AM, _VOCAB, _norm
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


def _linked(spark, sf):
    statuses = F.element_at(F.array(*map(F.lit, X.STATUSES)), (F.col("mention_id") % len(X.STATUSES) + 1).cast("int"))
    mentions = role(spark, sf, roles.MENTIONS).withColumn("status", statuses)
    vocab = role(spark, sf, roles.VOCAB).select("canonical", F.array("syn").alias("synonyms"))
    return L.link_mentions(mentions, role(spark, sf, roles.ALIASES), vocab)


@query()
def link_mentions(spark, sf):
    reasons = F.array_join("reasons", "|").alias("reasons")
    return _linked(spark, sf).select("mention_id", "norm", "term", "prediction", "accepted", "score", "confidence", reasons, "stage")


@query()
def reason_histogram(spark, sf):
    return _linked(spark, sf).select("stage", F.explode("reasons").alias("reason")).groupBy("stage", "reason").agg(F.count("*").alias("n"))


@query(rf"""WITH {_VOCAB}, {_AM}, u AS (SELECT DISTINCT {_norm('label')} AS label, {_norm('s')} AS s, a FROM (SELECT canonical AS label, alias AS s, true AS a FROM am UNION ALL SELECT canonical, syn, false FROM vocab)),
g AS (SELECT label, list_sort(list_distinct(list_append(list(s) FILTER (s <> ''), label))) AS syns, count(DISTINCT s) FILTER (a AND s <> '') AS n_aliases FROM u WHERE label <> '' GROUP BY label)
SELECT label, array_to_string(syns, '|') AS synonyms, n_aliases, (regexp_matches(label, '\b(and|with|plus)\b') OR (len(string_split(label, ' ')) >= 4)) AS combo FROM g""")
def link_universe(spark, sf):
    vocab = role(spark, sf, roles.VOCAB).select("canonical", F.array("syn").alias("synonyms"))
    u = L.universe(role(spark, sf, roles.ALIASES), vocab)
    return u.select("label", F.array_join("synonyms", "|").alias("synonyms"), F.size("aliases").cast("long").alias("n_aliases"), "combo")


@query()
def greedy_assignment(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.drug_norm(F.col("p_name")).alias("norm"))  # once a part, not once a line
    l = spark.read.parquet(f"{sf}/lineitem.parquet").join(p, F.col("l_partkey") == F.col("p_partkey"))
    rows = l.select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").cast("int").alias("pos"), "norm", F.col("l_partkey").alias("part"))
    truth = rows.withColumn("label", F.col("norm"))
    text = F.when(F.col("part") % 3 == 0, F.substring("norm", 1, 6)).otherwise(F.col("norm"))
    seeds = rows.where("pos <> 4").select("note_id", F.col("pos").cast("long").alias("ord"), F.concat(F.lit("u"), "note_id", F.lit("_"), "pos").alias("unit_id"), text.alias("norm"), text.alias("canonical"), F.array().cast("array<string>").alias("drugs"))
    return L.assign_greedy(truth, seeds)


@query(f"""WITH s AS ({duck(roles.TRUTH)}) SELECT note_id % 50 AS visit, count(*) AS mention_count, array_to_string(list_sort(list(DISTINCT raw)), '|') AS labels, count(*) FILTER (span_id % 3 <> 0) AS comparable_count, coalesce(array_to_string(list_sort(list(DISTINCT raw) FILTER (span_id % 3 <> 0)), '|'), '') AS comparable_labels FROM s GROUP BY 1""")
def visit_truth(spark, sf):
    t = role(spark, sf, roles.TRUTH).withColumn("comparable", F.col("span_id") % 3 != 0)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return t.groupBy((F.col("note_id") % 50).alias("visit")).agg(F.count("*").alias("mention_count"), labels(F.col("raw")).alias("labels"), F.count_if("comparable").alias("comparable_count"), labels(F.when(F.col("comparable"), F.col("raw"))).alias("comparable_labels"))


@query(f"""WITH s AS ({duck(roles.SCORES)}) SELECT coalesce(kind, 'all') AS kind, count(*) AS n, avg(correct::INT) AS accuracy, avg(accepted::INT) AS accept_rate, avg((NOT accepted)::INT) AS abstention, coalesce(count(*) FILTER (accepted AND correct) / nullif(count(*) FILTER (accepted), 0), 0)::DOUBLE AS accepted_precision FROM s GROUP BY GROUPING SETS ((), (kind))""")
def normalization_summary(spark, sf):
    s = role(spark, sf, roles.SCORES)
    d = lambda c: F.avg(c.cast("double"))
    g = s.rollup("kind").agg(F.count("*").alias("n"), d(F.col("correct")).alias("accuracy"), d(F.col("accepted")).alias("accept_rate"), d(~F.col("accepted")).alias("abstention"), F.coalesce(F.try_divide(F.count_if(F.col("accepted") & F.col("correct")), F.count_if("accepted")), F.lit(0.0)).alias("accepted_precision"))
    return g.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("""WITH k AS (SELECT l_orderkey, list(l_partkey % 20 ORDER BY l_linenumber, l_partkey % 20) AS top FROM lineitem GROUP BY 1), g AS (SELECT top, l_orderkey % 20 AS gold, l_orderkey % 3 AS stratum FROM k)
SELECT stratum, count(*) AS n, avg(list_contains(top[1:1], gold)::INT) AS recall_1, avg(list_contains(top[1:3], gold)::INT) AS recall_3, avg(list_contains(top[1:5], gold)::INT) AS recall_5, avg(list_contains(top, gold)::INT) AS recall_all FROM g GROUP BY 1""")
def oracle_recall(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    k = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 20).alias("v")))), lambda x: x["v"]).alias("top"))
    hit = lambda n: F.avg(F.array_contains(F.slice("top", 1, n), F.col("l_orderkey") % 20).cast("double"))
    return k.groupBy((F.col("l_orderkey") % 3).alias("stratum")).agg(F.count("*").alias("n"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), hit(1000).alias("recall_all"))


@query("""SELECT o_custkey AS person_id, count(*) AS visits, sum((o_totalprice > 150000)::INT)::BIGINT AS clinic_visits, avg((o_totalprice > 150000)::INT) AS clinic_ratio FROM orders GROUP BY 1 HAVING count(*) BETWEEN 3 AND 40 AND sum((o_totalprice > 150000)::INT) >= 2 AND avg((o_totalprice > 150000)::INT) >= 0.25""")
def eligible_patients(spark, sf):
    clinic = F.col("o_totalprice") > 150000
    g = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("person_id")).agg(F.count("*").alias("visits"), F.count_if(clinic).alias("clinic_visits"), F.avg(clinic.cast("double")).alias("clinic_ratio"))
    return g.where("visits between 3 and 40 and clinic_visits >= 2 and clinic_ratio >= 0.25")
