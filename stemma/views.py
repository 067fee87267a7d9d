"""Arrays, orders and trees derived from the driver's tables.

An array is a list of tokens, leftmost youngest. `event_arrays` has a group for each event type, an array for each
user and the tokens of its events; `brand_arrays` a group for each market segment, an array for each customer and the
brands it bought. Tokens stand in descending order in both, so every array follows one total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("group_id", "array_id").orderBy(F.desc("token"))
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("group_id", "array_id", "pos", "token")


def event_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, array_id, pos, token."""
    e = table(spark, sf_dir, "events")
    return _placed(e.select(F.col("event_type").alias("group_id"), F.col("user_id").alias("array_id"), F.get_json_object("props", "$.k").cast("int").alias("token")).distinct())


def brand_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, array_id, pos, token (the number in the brand's name)."""
    line, order = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part, customer = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    bought = line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey).join(customer, order.o_custkey == customer.c_custkey)
    return _placed(bought.select(F.col("c_mktsegment").alias("group_id"), F.col("c_custkey").alias("array_id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("token")).distinct())


def event_tree(arrays: DataFrame) -> DataFrame:
    """node_id, parent_id, branch_length, depth: user -> user mod 15 -> user mod 5 -> root, one tree for all groups."""
    users = arrays.select("array_id").distinct()
    leaf = F.concat(F.lit("u"), F.col("array_id"))
    nation, region = F.col("array_id") % 15, F.col("array_id") % 5
    leaves = users.select(leaf.alias("node_id"), F.concat(F.lit("n"), nation).alias("parent_id"), F.lit(1.0).alias("branch_length"), F.lit(3).alias("depth"))
    nations = users.select(F.concat(F.lit("n"), nation).alias("node_id"), F.concat(F.lit("r"), nation % 5).alias("parent_id"), F.lit(1.0).alias("branch_length"), F.lit(2).alias("depth")).distinct()
    regions = users.select(F.concat(F.lit("r"), region).alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1.0).alias("branch_length"), F.lit(1).alias("depth")).distinct()
    root = users.limit(1).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("branch_length"), F.lit(0).alias("depth"))
    return leaves.unionByName(nations).unionByName(regions).unionByName(root)


def nation_tree(spark: SparkSession, sf_dir: str, of: str = "customer") -> DataFrame:
    """node_id, parent_id, branch_length, depth: customer or supplier -> nation -> region -> root."""
    c, n, r = (table(spark, sf_dir, t) for t in (of, "nation", "region"))
    key, nation = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}[of]
    leaves = c.select(F.concat(F.lit("c"), key).alias("node_id"), F.concat(F.lit("n"), nation).alias("parent_id"), (F.col(key) % 7 + 1).cast("double").alias("branch_length"), F.lit(3).alias("depth"))
    nations = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), (F.col("n_nationkey") % 3 + 1).cast("double").alias("branch_length"), F.lit(2).alias("depth"))
    regions = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1.0).alias("branch_length"), F.lit(1).alias("depth"))
    root = r.limit(1).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("branch_length"), F.lit(0).alias("depth"))
    return leaves.unionByName(nations).unionByName(regions).unionByName(root)


#: The same for DuckDB, as common table expressions.
EVENT_ARRAYS_SQL = """
ev AS (SELECT DISTINCT event_type AS group_id, user_id AS array_id, CAST(json_extract_string(props, '$.k') AS INT) AS token FROM events),
arrays AS (SELECT group_id, array_id, CAST(row_number() OVER (PARTITION BY group_id, array_id ORDER BY token DESC) - 1 AS INT) AS pos, token FROM ev)"""
BRAND_ARRAYS_SQL = """
br AS (SELECT DISTINCT c_mktsegment AS group_id, c_custkey AS array_id, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS token
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey),
arrays AS (SELECT group_id, array_id, CAST(row_number() OVER (PARTITION BY group_id, array_id ORDER BY token DESC) - 1 AS INT) AS pos, token FROM br)"""
EVENT_TREE_SQL = """
users AS (SELECT DISTINCT array_id FROM arrays),
tree AS (
  SELECT 'u' || array_id AS node_id, 'n' || (array_id % 15) AS parent_id, 1.0::DOUBLE AS branch_length, 3 AS depth FROM users
  UNION ALL SELECT DISTINCT 'n' || (array_id % 15), 'r' || (array_id % 15 % 5), 1.0::DOUBLE, 2 FROM users
  UNION ALL SELECT DISTINCT 'r' || (array_id % 5), 'root', 1.0::DOUBLE, 1 FROM users
  UNION ALL SELECT DISTINCT 'root', NULL, 0.0::DOUBLE, 0 FROM users)"""
NATION_TREE_SQL = """
tree AS (
  SELECT 'c' || c_custkey AS node_id, 'n' || c_nationkey AS parent_id, (c_custkey % 7 + 1)::DOUBLE AS branch_length, 3 AS depth FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey % 3 + 1)::DOUBLE, 2 FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'root', 1.0::DOUBLE, 1 FROM region
  UNION ALL SELECT 'root', NULL, 0.0::DOUBLE, 0)"""
