"""The driver's star-schema tables as a graph, as communities and as model replies; each also as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import KnowledgeGraph

STEP = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _triples(df: DataFrame, kind: int, order: Column, subject: Column, label: str, obj: Column, s_type: Column | str | None, o_type: Column | str | None) -> DataFrame:
    lit = lambda t: t if isinstance(t, Column) else F.lit(t).cast("string")
    return df.select((F.lit(kind * STEP) + order.cast("long")).alias("ord"), subject.alias("subject"), F.lit(label).alias("label"), obj.alias("object"), lit(s_type).alias("subject_type"), lit(o_type).alias("object_type"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, subject, label, object, subject_type, object_type) over whole tables."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    trade = F.when(c("c_mktsegment") == "BUILDING", F.lit("organization")).when(c("c_mktsegment") == "MACHINERY", F.lit("robot"))
    parts = [
        _triples(t("nation"), 1, c("n_nationkey"), _name("nation", "n_nationkey"), "in region", _name("region", "n_regionkey"), "location", "location"),
        _triples(t("customer"), 2, c("c_custkey"), _name("customer", "c_custkey"), "lives in", _name("nation", "c_nationkey"), "person", None),
        _triples(t("supplier"), 3, c("s_suppkey"), _name("supplier", "s_suppkey"), "based in", _name("nation", "s_nationkey"), "organization", None),
        _triples(t("orders"), 4, c("o_orderkey"), _name("order", "o_orderkey"), "placed by", _name("customer", "o_custkey"), "event", None),
        _triples(t("lineitem"), 5, c("l_orderkey") * 10 + c("l_linenumber"), _name("part", "l_partkey"), "supplied by", _name("supplier", "l_suppkey"), "product", None),
        _triples(t("events"), 6, c("event_id"), _name("user", "user_id"), "did", F.concat(F.lit("event:"), c("event_type")), None, "unheard_of"),
        _triples(t("customer"), 7, c("c_custkey"), _name("nation", "c_nationkey"), "lives in", _name("customer", "c_custkey"), None, None),
        _triples(t("customer"), 8, c("c_custkey"), _name("customer", "c_custkey"), "trades with", _name("nation", "c_nationkey"), trade, None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES_SQL = f"""T AS (
    SELECT {STEP} + n_nationkey AS ord, 'nation:' || n_nationkey AS subject, 'in region' AS label, 'region:' || n_regionkey AS object, 'location' AS subject_type, 'location' AS object_type FROM nation
    UNION ALL SELECT {2 * STEP} + c_custkey, 'customer:' || c_custkey, 'lives in', 'nation:' || c_nationkey, 'person', NULL FROM customer
    UNION ALL SELECT {3 * STEP} + s_suppkey, 'supplier:' || s_suppkey, 'based in', 'nation:' || s_nationkey, 'organization', NULL FROM supplier
    UNION ALL SELECT {4 * STEP} + o_orderkey, 'order:' || o_orderkey, 'placed by', 'customer:' || o_custkey, 'event', NULL FROM orders
    UNION ALL SELECT {5 * STEP} + l_orderkey * 10 + l_linenumber, 'part:' || l_partkey, 'supplied by', 'supplier:' || l_suppkey, 'product', NULL FROM lineitem
    UNION ALL SELECT {6 * STEP} + event_id, 'user:' || user_id, 'did', 'event:' || event_type, NULL, 'unheard_of' FROM events
    UNION ALL SELECT {7 * STEP} + c_custkey, 'nation:' || c_nationkey, 'lives in', 'customer:' || c_custkey, NULL, NULL FROM customer
    UNION ALL SELECT {8 * STEP} + c_custkey, 'customer:' || c_custkey, 'trades with', 'nation:' || c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'organization' WHEN 'MACHINERY' THEN 'robot' END, NULL FROM customer),
E AS (
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY least(subject, object), greatest(subject, object), label ORDER BY ord) AS rn FROM T) WHERE rn = 1)"""

ADJ_SQL = """A AS (
    SELECT subject AS node, object AS neighbor, ord, subject, label, object FROM E
    UNION ALL SELECT object, subject, ord, subject, label, object FROM E WHERE subject <> object)"""


def graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    return KnowledgeGraph.of(triples(spark, sf_dir))


def stored_graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """The same for queries that use the graph more than once."""
    return graph(spark, sf_dir).stored()


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comm, node): nations with their customers and suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("nation").select(F.col("n_nationkey").cast("long").alias("comm"), _name("nation", "n_nationkey").alias("node"))
    rows = rows.unionByName(t("customer").select(F.col("c_nationkey").cast("long").alias("comm"), _name("customer", "c_custkey").alias("node")))
    return rows.unionByName(t("supplier").select(F.col("s_nationkey").cast("long").alias("comm"), _name("supplier", "s_suppkey").alias("node")))


MEMBERS_SQL = """M AS (
    SELECT n_nationkey::BIGINT AS comm, 'nation:' || n_nationkey AS node FROM nation
    UNION ALL SELECT c_nationkey::BIGINT, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT s_nationkey::BIGINT, 'supplier:' || s_suppkey FROM supplier)"""

def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comm, node): each part with the lowest of its suppliers, a partition whose communities are linked."""
    low = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("comm"))
    rows = low.select("comm", _name("part", "l_partkey").alias("node"))
    return rows.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("comm"), _name("supplier", "s_suppkey").alias("node")))


WITH_PARTS = f"""WITH {TRIPLES_SQL}, M AS (
    SELECT min(l_suppkey) AS comm, 'part:' || l_partkey AS node FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT s_suppkey, 'supplier:' || s_suppkey FROM supplier)"""
WITH = f"WITH {TRIPLES_SQL}"
WITH_ADJ = f"WITH {TRIPLES_SQL}, {ADJ_SQL}"
WITH_COMM = f"WITH {TRIPLES_SQL}, {MEMBERS_SQL}"


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(center): every customer whose key is divisible by 50, the query set of searches."""
    return table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(_name("customer", "c_custkey").alias("center"))


CENTERS_SQL = "C AS (SELECT 'customer:' || c_custkey AS center FROM customer WHERE c_custkey % 50 = 0)"


def whole_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comm, node) of every node: nations with what belongs to them, orders with their customer's nation, parts with their
    first supplier's, users and events by themselves, regions together."""
    t = lambda n: table(spark, sf_dir, n)
    long = lambda c: F.col(c).cast("long")
    rows = membership(spark, sf_dir)
    ordered = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.unionByName(ordered.select(long("c_nationkey").alias("comm"), _name("order", "o_orderkey").alias("node")))
    first = t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).join(t("supplier"), F.col("s") == F.col("s_suppkey"))
    rows = rows.unionByName(first.select(long("s_nationkey").alias("comm"), _name("part", "l_partkey").alias("node")))
    rows = rows.unionByName(t("region").select(F.lit(-1).cast("long").alias("comm"), _name("region", "r_regionkey").alias("node")))
    rows = rows.unionByName(t("events").select((-2 - F.col("user_id")).alias("comm"), _name("user", "user_id").alias("node")).distinct())
    return rows.unionByName(t("events").select(F.lit(1000).cast("long").alias("comm"), F.concat(F.lit("event:"), F.col("event_type")).alias("node")).distinct())


WHOLE_SQL = """M AS (
    SELECT n_nationkey::BIGINT AS comm, 'nation:' || n_nationkey AS node FROM nation
    UNION ALL SELECT c_nationkey::BIGINT, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT s_nationkey::BIGINT, 'supplier:' || s_suppkey FROM supplier
    UNION ALL SELECT c_nationkey::BIGINT, 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT s_nationkey::BIGINT, 'part:' || l_partkey FROM (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) JOIN supplier ON s = s_suppkey
    UNION ALL SELECT -1, 'region:' || r_regionkey FROM region
    UNION ALL SELECT DISTINCT -2 - user_id, 'user:' || user_id FROM events
    UNION ALL SELECT DISTINCT 1000, 'event:' || event_type FROM events)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, response): scored items in both notations, one a part."""
    k = F.col("p_partkey")
    digit = lambda n: F.concat(F.lit("0."), F.pmod(k, F.lit(n)).cast("string"))
    text = F.concat(F.lit("1. {"), F.col("p_name"), F.lit(" (Score: "), digit(10), F.lit(")}: likely\n2. ** "), F.col("p_brand"), F.lit("  (Score: "), digit(7), F.lit(") :**\n{odd (Score: x)} {("), F.col("p_type"), F.lit(" | size | "), F.col("p_size").cast("string"), F.lit(") (Score: 0.5) }"))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("response"))


REPLIES_SQL = """R AS (
    SELECT p_partkey AS id, '1. {' || p_name || ' (Score: 0.' || (p_partkey % 10) || ')}: likely' || chr(10) || '2. ** ' || p_brand || '  (Score: 0.' || (p_partkey % 7) || ') :**' || chr(10) || '{odd (Score: x)} {(' || p_type || ' | size | ' || p_size || ') (Score: 0.5) }' AS response FROM part)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, response): a labelled document's verdict in braces and as a block of lines."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    text = F.concat(
        F.when(q, F.lit("So {Yes}")).otherwise(F.lit("{No} then")), F.when(t, F.lit(" and {yes}.")).otherwise(F.lit(".")),
        F.lit('\n{\n"Accuracy": "'), F.when(q, F.lit("True")).otherwise(F.lit("False")), F.lit('"\n}\n'),
        F.when(t, F.lit("")).otherwise(F.concat(F.lit('{\n"query": "about '), F.col("doc_id").cast("string"), F.lit('"\n}'))))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), text.alias("response"))


VERDICTS_SQL = """V AS (
    SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'So {Yes}' ELSE '{No} then' END || CASE WHEN toxic = 1 THEN ' and {yes}.' ELSE '.' END || chr(10) || '{' || chr(10) || '"Accuracy": "' || CASE WHEN quality = 1 THEN 'True' ELSE 'False' END || '"' || chr(10) || '}' || chr(10)
        || CASE WHEN toxic = 1 THEN '' ELSE '{' || chr(10) || '"query": "about ' || doc_id || '"' || chr(10) || '}' END AS response FROM labels)"""


def used_edges(spark: SparkSession, sf_dir: str, kg: KnowledgeGraph | None = None) -> DataFrame:
    """(qid, ord, subject, label, object, round): a search that has taken all facts of where customers live (round 1)
    and of whom they trade with (round 2)."""
    e = (kg or graph(spark, sf_dir)).edges.where(F.col("label").isin("lives in", "trades with"))
    return e.select(F.lit(0).cast("long").alias("qid"), "ord", "subject", "label", "object", F.when(F.col("label") == "lives in", F.lit(1)).otherwise(F.lit(2)).alias("round"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, topic, topic_score): every nation and customer, scored by its key."""
    n = table(spark, sf_dir, "nation").select(_name("nation", "n_nationkey").alias("topic"), ((F.col("n_nationkey") % 4 + 1) / 8.0).alias("topic_score"))
    c = table(spark, sf_dir, "customer").select(_name("customer", "c_custkey").alias("topic"), ((F.col("c_custkey") % 4 + 1) / 8.0).alias("topic_score"))
    return n.unionByName(c).select(F.lit(0).cast("long").alias("qid"), "topic", "topic_score")


SEARCH_SQL = """U AS (SELECT ord, CASE label WHEN 'lives in' THEN 1 ELSE 2 END AS round FROM E WHERE label IN ('lives in', 'trades with')),
F AS (
    SELECT 'nation:' || n_nationkey AS topic, (n_nationkey % 4 + 1) / 8.0::DOUBLE AS topic_score FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, (c_custkey % 4 + 1) / 8.0::DOUBLE FROM customer)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): a question about every customer whose key is divisible by 50, which names it and its nation."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("Which orders did Customer:"), k, F.lit(" of nation:"), n, F.lit(" place?"))
    return table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("qid"), text.alias("query"))
