"""Queries that write tables as files and read them back; their SQL twins answer from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import sinks, views
from stemma.operators import cluster
from stemma.operators import tree as trees
from stemma.sources import readers
from stemma.tables import new_path

from .table_queries import BR, NT

QUERIES: dict = {}
SQL: dict[str, str] = {}
SMALL = 290


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(BR + " SELECT group_id, array_id::VARCHAR AS array_id, pos, token::VARCHAR AS token FROM arrays")
def arrays_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each group, found by its ending, the group in its name, the array in the header."""
    path = new_path(spark, "fasta")
    sinks.write_fasta(views.brand_arrays(spark, sf_dir), path)
    return readers.read_arrays(spark, path)


@query(BR + f", n AS (SELECT group_id, count(DISTINCT array_id) AS n FROM arrays GROUP BY ALL) SELECT CASE WHEN n <= {SMALL} THEN 'small_groups' ELSE 'groups' END AS kind, group_id, array_id::VARCHAR AS array_id, pos, token::VARCHAR AS token FROM arrays JOIN n USING (group_id)")
def arrays_through_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "folders")
    sinks.write_arrays(views.brand_arrays(spark, sf_dir), path, SMALL)
    return readers.read_array_folders(spark, path)


LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ACGTACGTACGTACGTACGTACGTACN"
STRANDS = f"""
lines AS (SELECT n_regionkey::VARCHAR AS group_id, n_nationkey::VARCHAR AS array_id, n_nationkey % 3 = 0 AS minus, k, substr(translate(n_name, '{LETTERS}', '{BASES}'), k + 1) AS s FROM nation, unnest(range(3)) u(k)),
strands AS (SELECT group_id, array_id, CASE WHEN minus THEN 'neg_strand' ELSE 'pos_strand' END AS strand, CAST(CASE WHEN minus THEN 2 - k ELSE k END AS INT) AS pos, CASE WHEN minus THEN translate(reverse(regexp_replace(s, '[^ACGTN]', 'N', 'g')), 'ACGT', 'TGCA') ELSE s END AS sequence FROM lines)"""


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, in a folder for its strand in a folder for its region; three sequences each."""
    path, n = new_path(spark, "strands"), views.table(spark, sf_dir, "nation")
    s = F.translate("n_name", LETTERS, BASES)
    rows = n.select(F.col("n_regionkey").cast("string").alias("g"), F.when(F.col("n_nationkey") % 3 == 0, "neg_strand").otherwise("pos_strand").alias("s"), F.col("n_nationkey").cast("string").alias("a"), F.concat_ws("\n", F.concat(F.lit("> of "), "n_name"), *(F.substring(s, k + 1, 99) for k in range(3))).alias("value"))
    rows.repartition("g", "s", "a").write.partitionBy("g", "s", "a").text(path)
    sinks.rename_files(spark, path, rows.select(F.format_string("g=%s/s=%s/a=%s", "g", "s", "a").alias("folder"), F.format_string("%s/%s/%s.fa", "g", "s", "a").alias("name")))
    return readers.read_strands(spark, path)


@query(f"WITH {STRANDS} SELECT * FROM strands")
def strands_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strands(spark, sf_dir)


@query(f"WITH {STRANDS}, f AS (SELECT group_id, sequence, min(CASE strand WHEN 'pos_strand' THEN '0' ELSE '1' END || array_id || '/' || pos) AS place FROM strands GROUP BY ALL), i AS (SELECT group_id, sequence, CAST(row_number() OVER (PARTITION BY group_id ORDER BY place) - 1 AS INT) AS token FROM f) SELECT group_id, array_id, pos, token FROM strands JOIN i USING (group_id, sequence)")
def enumerated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences numbered by their first occurrence in the group, plus strand first."""
    return readers.enumerated(_strands(spark, sf_dir))


FOUND = f"""
found AS (SELECT n_regionkey, 's' || n_regionkey AS sequence_id, n_name AS array_id, n_nationkey::BIGINT * 10 AS start, n_nationkey::BIGINT * 10 + 7 AS "end", CASE n_nationkey % 2 WHEN 0 THEN '+' ELSE '-' END AS direction,
  translate(n_name, '{LETTERS}', '{BASES}') AS repeat, [translate(substr(n_name, k + 1), '{LETTERS}', '{BASES}') FOR k IN range(3)] AS tokens, n_nationkey % 6 AS level FROM nation)"""


def _finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result.json for each region, in a folder of its own; found by that name."""
    path, n = new_path(spark, "finder"), views.table(spark, sf_dir, "nation")
    dna = lambda c: F.translate(c, LETTERS, BASES)
    region = lambda kind, s: F.struct(F.lit(kind).alias("Type"), s.alias("Sequence"))
    regions = F.array(*(x for k in range(3) for x in (region("DR", dna(F.col("n_name"))), region("Spacer", dna(F.substring("n_name", k + 1, 99))))))
    key = F.col("n_nationkey").cast("long")
    array = F.struct(F.col("n_name").alias("Name"), (key * 10).alias("Start"), (key * 10 + 7).alias("End"), (key % 6).cast("int").alias("Evidence_Level"), dna(F.col("n_name")).alias("DR_Consensus"), F.when(key % 2 == 0, "+").otherwise("-").alias("CRISPRDirection"), F.lit("ND").alias("Potential_Orientation"), regions.alias("Regions"))
    one = n.groupBy(F.col("n_regionkey").cast("string").alias("g")).agg(F.collect_list(array).alias("Crisprs"))
    text = one.select("g", F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("s"), "g").alias("Id"), F.lit(10).alias("Length"), "Crisprs")).alias("Sequences"))).alias("value"))
    text.repartition("g").write.partitionBy("g").text(path)
    sinks.rename_files(spark, path, text.select(F.format_string("g=%s", "g").alias("folder"), F.format_string("region%s/result.json", "g").alias("name")))
    return readers.read_finder(spark, f"{path}/*/result.json")


@query(f"WITH {FOUND} SELECT sequence_id, array_id, start, \"end\", direction, 'ND' AS orientation, repeat, array_to_string(tokens, ',') AS tokens, array_to_string([repeat, repeat, repeat], ',') AS repeats FROM found WHERE level >= 4")
def finder_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with enough evidence; repeats and spacers told apart."""
    return _finder(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("tokens", "repeats")})


_RC = "translate(reverse({}), 'ACGT', 'TGCA')"


@query(f"WITH {FOUND} SELECT array_id, CASE direction WHEN '-' THEN {_RC.format('repeat')} ELSE repeat END AS repeat, CASE direction WHEN '-' THEN array_to_string([{_RC.format('x')} FOR x IN list_reverse(tokens)], ',') ELSE array_to_string(tokens, ',') END AS tokens FROM found WHERE level >= 4")
def reoriented_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays read in the direction of the plus strand."""
    return cluster.by_repeat(_finder(spark, sf_dir)).select("array_id", "repeat", F.array_join("tokens", ",").alias("tokens"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.nation_tree(spark, sf_dir, "supplier").withColumn("group_id", F.lit("suppliers"))


SUPPLIER_TREE = NT.replace("'c' || c_custkey AS node_id, 'n' || c_nationkey AS parent_id, (c_custkey % 7 + 1)", "'c' || s_suppkey AS node_id, 'n' || s_nationkey AS parent_id, (s_suppkey % 7 + 1)").replace("FROM customer", "FROM supplier")
#: Children stand in order of their names, so pre-order is the order of paths.
PATHS = SUPPLIER_TREE + """,
inner_nodes AS (SELECT DISTINCT parent_id FROM tree WHERE parent_id IS NOT NULL),
paths AS (SELECT node_id, node_id AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.node_id, p.path || '/' || t.node_id FROM paths p JOIN tree t ON t.parent_id = p.node_id),
placed AS (SELECT t.*, t.node_id NOT IN (SELECT parent_id FROM inner_nodes) AS is_leaf, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS pre_ord FROM tree t JOIN paths USING (node_id))"""


@query(PATHS + " SELECT node_id, parent_id, branch_length, depth, is_leaf, pre_ord FROM placed")
def newick_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree as Newick text and read again, nodes in pre-order."""
    return readers.tree_nodes(sinks.newick(_nations(spark, sf_dir))).drop("group_id")


@query(PATHS + ", named AS (SELECT *, depth IN (1, 2) AND NOT is_leaf AS free FROM placed) SELECT pre_ord, CASE WHEN free THEN 'in_' || (row_number() OVER (PARTITION BY free ORDER BY pre_ord) - 1) ELSE node_id END AS name FROM named")
def named_inner_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner nodes whose names are taken away get new ones in pre-order."""
    t = readers.tree_nodes(sinks.newick(_nations(spark, sf_dir))).withColumn("name", F.when(F.col("is_leaf") | ~F.col("depth").isin(1, 2), F.col("node_id")))
    return trees.named_inner_nodes(t).select("pre_ord", "name")


@query("WITH n AS (SELECT s_nationkey, s_suppkey FROM supplier) SELECT s_nationkey::VARCHAR AS group_id, count(*) AS n_leaves, 'c' || min(s_suppkey) AS least, sum(s_suppkey % 7 + 1)::DOUBLE AS total_length FROM n GROUP BY ALL")
def tree_map_through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each nation, all in one JSON object, read again."""
    path, s = new_path(spark, "trees"), views.table(spark, sf_dir, "supplier")
    group = F.col("s_nationkey").cast("string").alias("group_id")
    leaves = s.select(group, F.concat(F.lit("c"), "s_suppkey").alias("node_id"), F.lit("root").alias("parent_id"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("branch_length"))
    roots = s.select(group, F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("branch_length")).distinct()
    sinks.as_json_map(sinks.newick(leaves.unionByName(roots)), "group_id", "newick").select("json").write.text(path)
    nodes = readers.tree_nodes(readers.read_tree_map(spark, path)).where("is_leaf")
    number = F.substring("node_id", 2, 99).cast("long")
    return nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_leaves"), F.concat(F.lit("c"), F.min(number)).alias("least"), F.sum("branch_length").alias("total_length"))


def _tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("n_nationkey") % 4 != 3)
    path = new_path(spark, "tree-files")
    rows = n.select(F.concat_ws("_", "r_name", F.col("n_nationkey").cast("string")).alias("f"), F.format_string("(%s,b);", "n_name").alias("value"))
    rows.repartition("f").write.partitionBy("f").text(path)
    sinks.rename_files(spark, path, rows.select(F.format_string("f=%s", "f").alias("folder"), F.format_string("%s.nwk", "f").alias("name")))
    return readers.read_tree_files(spark, path)


TREE_FILES = "files AS (SELECT r_name || '_' || n_nationkey || '.nwk' AS file, '(' || n_name || ',b);' AS newick FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 3), groups AS (SELECT r_name AS group_id FROM region UNION ALL SELECT n_name FROM nation)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "region").select(F.col("r_name").alias("group_id")).unionByName(views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("group_id")))


@query(f"WITH {TREE_FILES} SELECT group_id, arg_min(newick, file) AS newick FROM groups JOIN files ON starts_with(file, group_id) GROUP BY ALL")
def trees_bound_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the files that begin with a group's name has its tree."""
    return readers.bind_trees(_groups(spark, sf_dir), _tree_files(spark, sf_dir))


@query(f"WITH {TREE_FILES} SELECT DISTINCT group_id FROM groups WHERE NOT EXISTS (SELECT 1 FROM files WHERE starts_with(file, group_id))")
def groups_without_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    return readers.without_tree(groups, readers.bind_trees(groups, _tree_files(spark, sf_dir)))


@query("SELECT n_regionkey::VARCHAR AS group_id, n_name AS array_id, CAST(k AS INT) AS pos, substr(n_name, k + 1, 2) AS token FROM nation, unnest(range(4)) u(k) WHERE k < length(n_name)")
def named_lists_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of `name: a, b, c` lines under a head in parentheses."""
    path, n = new_path(spark, "lists"), views.table(spark, sf_dir, "nation")
    tokens = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(3), F.length("n_name") - 1)), lambda k: F.substring(F.col("n_name"), k + 1, F.lit(2))), ", ")
    rows = n.select(F.col("n_regionkey").cast("string").alias("g"), F.concat(F.col("n_name"), F.lit(": "), tokens).alias("line"))
    text = rows.groupBy("g").agg(F.concat(F.lit("('a head', 'of two')\n\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("value"))
    text.repartition("g").write.partitionBy("g").text(path)
    sinks.rename_files(spark, path, text.select(F.format_string("g=%s", "g").alias("folder"), F.format_string("%s.txt", "g").alias("name")))
    return readers.read_named_lists(spark, path)


def _protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_suppkey") % 5 == 0, "trivial").when(F.col("s_suppkey") % 11 == 0, "skipped").otherwise("main")
    return s.select(F.col("s_name").alias("group_id"), status.alias("status"), F.array(F.col("s_suppkey") / 4.0, F.lit(None).cast("double"), F.col("s_suppkey") % 3 * 1.0).alias("sizes"), (F.col("s_suppkey") * 0.5).alias("lrt"), F.array(F.lit(1), F.lit(2)).alias("loss_blocks"), F.lit("(a,b);").alias("tree"))


@query("SELECT s_name AS group_id, s_suppkey / 4.0 AS first, (s_suppkey % 3)::DOUBLE AS last, 3 AS n, s_suppkey * 0.5::DOUBLE AS lrt, 4 AS columns FROM supplier")
def results_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without detail columns; a list is text in the file and a list again behind it."""
    path = new_path(spark, "results")
    sinks.write_results(_protocol(spark, sf_dir), path)
    got = readers.read_lists_csv(spark, path, "sizes")
    return got.select("group_id", F.get("sizes", F.lit(0)).alias("first"), F.get("sizes", F.lit(2)).alias("last"), F.size("sizes").alias("n"), F.col("lrt").cast("double").alias("lrt"), F.lit(len(got.columns)).alias("columns"))


@query("WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'trivial' WHEN s_suppkey % 11 = 0 THEN 'skipped' ELSE 'main' END AS status FROM supplier) SELECT status, count(*) AS n, sum(s_suppkey * 0.5)::DOUBLE AS lrt FROM p GROUP BY ALL")
def protocol_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write for main, trivial and skipped groups."""
    path = new_path(spark, "protocol")
    sinks.write_by_status(_protocol(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("lrt").alias("lrt"))


@query("SELECT count(*) AS n, sum(s_suppkey * 0.5)::DOUBLE AS lrt FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey IN (3, 5))")
def result_without_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written protocol as the next run's parameters, without groups that are named."""
    path, p = new_path(spark, "protocol"), _protocol(spark, sf_dir)
    p.write.parquet(path)
    named = [r[0] for r in p.where(F.col("lrt").isin(1.5, 2.5)).select("group_id").collect()]
    return readers.read_result(spark, path, named).agg(F.count(F.lit(1)).alias("n"), F.sum("lrt").alias("lrt"))
