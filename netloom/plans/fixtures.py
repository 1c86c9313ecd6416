"""Domain tables derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators.network import Network


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label``: parts; small ones are positives."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") <= 5).alias("label"))


GENES = "SELECT CAST(p_partkey AS STRING) AS id, p_size <= 5 AS label FROM part"


def _shared(rows: DataFrame, group: list[str]) -> DataFrame:
    """``src, dst, w`` of ids that share groups; members bring their counts along, so pairs are shuffled once."""
    member = rows.repartition("id").distinct()
    sized = member.withColumn("n", F.count("*").over(Window.partitionBy("id"))).repartition(*group)
    pair = sized.select(*group, F.col("id").alias("src"), F.col("n").alias("na")).join(sized.select(*group, F.col("id").alias("dst"), F.col("n").alias("nb")), group).where("src < dst")
    together = pair.repartition("dst").groupBy("src", "dst", "na", "nb").agg(F.count("*").alias("both"))
    return together.select("src", "dst", (F.col("both") / F.sqrt((F.col("na") * F.col("nb")).cast("double"))).alias("w"))


def net_a(spark: SparkSession, sf_dir: str) -> Network:
    """Parts linked by shared orders; an order has a handful of parts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("id"))
    return Network(genes(spark, sf_dir).select("id"), _shared(rows, ["l_orderkey"]))


def net_b(spark: SparkSession, sf_dir: str) -> Network:
    """Parts linked by a supplier and month of shipping."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_trunc("month", "l_shipdate").alias("m"), F.col("l_partkey").cast("string").alias("id"))
    return Network(genes(spark, sf_dir).select("id"), _shared(rows, ["l_suppkey", "m"]))


def _shared_sql(name: str, group: str, on: str) -> str:
    return f"""{name}_m AS (SELECT DISTINCT {group}, CAST(l_partkey AS STRING) AS id FROM lineitem),
{name}_n AS (SELECT id, count(*) AS n FROM {name}_m GROUP BY id),
{name}_p AS (SELECT x.id AS src, y.id AS dst, count(*) AS both_n FROM {name}_m x JOIN {name}_m y ON {on} AND x.id < y.id GROUP BY x.id, y.id),
{name} AS (SELECT src, dst, both_n / sqrt(CAST(a.n * b.n AS DOUBLE)) AS w FROM {name}_p JOIN {name}_n a ON a.id = src JOIN {name}_n b ON b.id = dst)"""


NET_A = _shared_sql("net_a", "l_orderkey", "x.l_orderkey = y.l_orderkey")
NET_B = _shared_sql("net_b", "l_suppkey, date_trunc('month', l_shipdate) AS m", "x.l_suppkey = y.l_suppkey AND x.m = y.m")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, gene, grp, vscore`` of case and control lines; ids may repeat."""
    line = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N"))
    part = F.col("l_partkey").cast("string")
    return line.select(F.concat(part, F.lit("_"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), part.alias("gene"), F.when(F.col("l_returnflag") == "R", "case").otherwise("control").alias("grp"), (F.col("l_discount") * 10).alias("vscore"))


VARIANTS = """SELECT CAST(l_partkey AS STRING) || '_' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
CAST(l_partkey AS STRING) AS gene, CASE WHEN l_returnflag = 'R' THEN 'case' ELSE 'control' END AS grp, l_discount * 10 AS vscore
FROM lineitem WHERE l_returnflag IN ('R', 'N')"""


def gene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, score``: retail prices scaled to at most 1."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_retailprice") - 900).alias("x"))
    return part.join(F.broadcast(part.agg(F.max("x").alias("top")))).select("id", (F.col("x") / F.col("top")).alias("score"))


GENE_SCORES = "SELECT CAST(p_partkey AS STRING) AS id, (p_retailprice - 900) / (SELECT max(p_retailprice - 900) FROM part) AS score FROM part"


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``child, parent``: suppliers under nations under regions under a root, and under balance buckets."""
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    bucket = F.concat(F.lit("B:"), F.floor(F.col("s_acctbal") / 2000).cast("string"))
    return (
        s.select(name("S:", "s_suppkey").alias("child"), name("N:", "s_nationkey").alias("parent"))
        .union(n.select(name("N:", "n_nationkey"), name("R:", "n_regionkey")))
        .union(r.select(name("R:", "r_regionkey"), F.lit("ROOT")))
        .union(s.select(name("S:", "s_suppkey"), bucket))
        .union(s.select(bucket, F.lit("ROOT")))
        .distinct()
    )


ONTOLOGY = """ont AS (SELECT DISTINCT child, parent FROM (
SELECT 'S:' || CAST(s_suppkey AS STRING) AS child, 'N:' || CAST(s_nationkey AS STRING) AS parent FROM supplier
UNION ALL SELECT 'N:' || CAST(n_nationkey AS STRING), 'R:' || CAST(n_regionkey AS STRING) FROM nation
UNION ALL SELECT 'R:' || CAST(r_regionkey AS STRING), 'ROOT' FROM region
UNION ALL SELECT 'S:' || CAST(s_suppkey AS STRING), 'B:' || CAST(CAST(floor(s_acctbal / 2000) AS BIGINT) AS STRING) FROM supplier
UNION ALL SELECT 'B:' || CAST(CAST(floor(s_acctbal / 2000) AS BIGINT) AS STRING), 'ROOT' FROM supplier))"""


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, term, score``: parts annotated with their suppliers, scored by the largest discount."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_partkey").cast("string").alias("seq"), F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("term")).agg((F.max("l_discount") * 10).alias("score"))


ANNOTATION = "anno AS (SELECT CAST(l_partkey AS STRING) AS seq, 'S:' || CAST(l_suppkey AS STRING) AS term, max(l_discount) * 10 AS score FROM lineitem GROUP BY 1, 2)"


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, score, label``: document lengths against the quality label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("label"))


LABELLED = "roc AS (SELECT l.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, l.quality = 1 AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, item, p, t``: mean value and activity of a user by kind of event."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("item")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return e.join(F.broadcast(e.agg(F.max("v").alias("top")))).select("entity", "item", F.round(F.col("v") / F.col("top"), 9).alias("p"), (F.col("n") > 14).alias("t"))


PANEL = """cells AS (SELECT CAST(user_id AS STRING) AS entity, event_type AS item, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
panel AS (SELECT entity, item, round(v / (SELECT max(v) FROM cells), 9) AS p, n > 14 AS t FROM cells)"""
