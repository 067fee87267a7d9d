"""Queries over brand arrays, trees, strings and the analysis layer; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import views
from stemma.functions import scalar as fn
from stemma.operators import analysis, arrays, cluster, orient, tree

from .event_queries import EV, Events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BR = "WITH " + views.BRAND_ARRAYS_SQL
PACKED = ", packed AS (SELECT group_id, array_id, list(token ORDER BY pos) AS tokens FROM arrays GROUP BY ALL)"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.brand_arrays(spark, sf_dir)


@query(BR + PACKED + " SELECT group_id, min(array_id) AS representative, string_agg(array_id::VARCHAR, ',' ORDER BY array_id) AS members, count(*) AS n, len(any_value(tokens)) AS length FROM packed GROUP BY group_id, tokens")
def array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arrays.dedup(_brands(spark, sf_dir))
    return out.select("group_id", "representative", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "n", F.size("tokens").alias("length"))


@query(BR + " SELECT g.group_id, g.array_id, t.token, CAST(x.token IS NOT NULL AS INT) AS present FROM (SELECT DISTINCT group_id, array_id FROM arrays) g JOIN (SELECT DISTINCT group_id, token FROM arrays) t USING (group_id) LEFT JOIN arrays x ON x.group_id = g.group_id AND x.array_id = g.array_id AND x.token = t.token")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _brands(spark, sf_dir)
    return arrays.presence(b, b)


@query(BR + ", n AS (SELECT *, max(pos) OVER (PARTITION BY group_id, array_id) AS last FROM arrays) SELECT group_id, array_id, last - pos AS pos, token FROM n")
def reversed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.reversed_arrays(_brands(spark, sf_dir))


@query(BR + PACKED + ", f AS (SELECT group_id, count(*) AS n_arrays, count(DISTINCT tokens) AS n_unique FROM packed GROUP BY ALL) SELECT *, CASE WHEN n_arrays < 2 THEN 'minimum_array_number' WHEN n_unique > 290 THEN 'maximum_unique_array_number' WHEN group_id IN ('BUILDING') THEN 'selection not in groups' END AS skip_reason FROM f")
def group_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.group_selection(_brands(spark, sf_dir), [("minimum_array_number", 2), ("maximum_unique_array_number", 290), (None, None), ("selection not in groups", ["BUILDING"])])


@query(BR + ", l AS (SELECT group_id, array_id, count(*) AS length FROM arrays GROUP BY ALL) SELECT group_id, round(avg(length), 6) AS mean_length, min(length) AS shortest, max(length) AS longest FROM l GROUP BY ALL")
def array_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _brands(spark, sf_dir).groupBy("group_id", "array_id").agg(F.count(F.lit(1)).alias("length"))
    return lengths.groupBy("group_id").agg(F.round(F.avg("length"), 6).alias("mean_length"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


@query(BR + ", l AS (SELECT group_id, array_id, count(*) AS length FROM arrays GROUP BY ALL), b AS (SELECT CASE WHEN length > 0 AND length <= 10 THEN '(0, 10]' WHEN length > 10 AND length <= 18 THEN '(10, 18]' WHEN length > 18 AND length <= 25 THEN '(18, 25]' END AS bucket FROM l) SELECT bucket, count(*) AS n FROM b GROUP BY ALL")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _brands(spark, sf_dir).groupBy("group_id", "array_id").agg(F.count(F.lit(1)).alias("length"))
    return lengths.groupBy(analysis.length_bucket(F.col("length"), [0, 10, 18, 25]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(BR + ", l AS (SELECT group_id, array_id, count(*) AS length FROM arrays GROUP BY ALL), h AS (SELECT group_id, floor(length / 2.0)::BIGINT * 2.0::DOUBLE AS bin, count(*) AS n FROM l GROUP BY ALL) SELECT group_id, bin, n, round(n / sum(n) OVER (PARTITION BY group_id), 9) AS share FROM h")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _brands(spark, sf_dir).groupBy("group_id", "array_id").agg(F.count(F.lit(1)).alias("length"))
    return analysis.histogram(lengths, "length", 2.0, "group_id").withColumn("share", F.round("share", 9))


@query(EV + ", f AS (SELECT token, min(group_id || '/' || lpad(array_id::VARCHAR, 12, '0') || '/' || lpad(pos::VARCHAR, 6, '0')) AS place FROM arrays GROUP BY ALL) SELECT token, CAST(row_number() OVER (ORDER BY place, token) AS INT) AS id FROM f")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.first_seen_ids(views.event_arrays(spark, sf_dir), "token", "group_id", "array_id", "pos").withColumn("id", F.col("id").cast("int"))


RAW = "raw AS (SELECT event_type AS group_id, user_id AS array_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, CAST(json_extract_string(props, '$.k') AS INT) AS token FROM events)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in the order of their events, copies included."""
    from pyspark.sql import Window

    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("group_id"), F.col("user_id").alias("array_id"), "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("token"))
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("group_id", "array_id").orderBy("ts", "event_id")) - 1).select("group_id", "array_id", "pos", "token")


@query(f"WITH {RAW}, f AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY group_id, array_id, token ORDER BY pos) = 1) SELECT group_id, array_id, CAST(row_number() OVER (PARTITION BY group_id, array_id ORDER BY pos) - 1 AS INT) AS pos, token FROM f")
def unique_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.unique_in_order(_raw(spark, sf_dir))


@query(f"WITH {RAW}, c AS (SELECT *, row_number() OVER (PARTITION BY group_id, array_id, token ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY group_id, array_id, token) AS n FROM raw) SELECT group_id, array_id, pos, token, CASE WHEN n > 1 THEN token::VARCHAR || repeat(chr(CAST(65 + k % 26 AS INT)), CAST(k // 26 + 1 AS INT)) ELSE token::VARCHAR END AS name FROM c")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.duplicate_names(_raw(spark, sf_dir))


@query(f"WITH {RAW} SELECT group_id, token, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.duplicate_counts(_raw(spark, sf_dir), "group_id", "token")


SEEN = "seen AS (SELECT DISTINCT event_type AS group_id, CAST(json_extract_string(props, '$.k') AS INT) AS token FROM events WHERE value > 95)"


def _valuable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").where(F.col("value") > 95)
    return e.select(F.col("event_type").alias("group_id"), F.get_json_object("props", "$.k").cast("int").alias("token"))


@query(EV + f", {SEEN} SELECT e.group_id, e.token FROM (SELECT DISTINCT group_id, token FROM arrays) e ANTI JOIN seen x ON x.group_id = e.group_id AND x.token = e.token")
def never_seen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.event_arrays(spark, sf_dir)
    return arrays.never_seen(a, _valuable(spark, sf_dir))


@query(EV + f", {SEEN} SELECT group_id, array_id, token FROM arrays SEMI JOIN seen USING (group_id, token)")
def observed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.event_arrays(spark, sf_dir)
    return arrays.observed_only(a, _valuable(spark, sf_dir)).select("group_id", "array_id", "token")


PAIRS = (
    "WITH RECURSIVE "
    + views.EVENT_ARRAYS_SQL
    + """,
few AS (SELECT group_id || '_' || (array_id // 20) AS group_id, array_id, token, 99 - token AS col FROM arrays),
ids AS (SELECT DISTINCT group_id, array_id FROM few),
pairs AS (SELECT x.group_id, x.array_id AS a, y.array_id AS b FROM ids x JOIN ids y ON x.group_id = y.group_id AND x.array_id > y.array_id),
cells AS (
  SELECT p.group_id, p.a, p.b, c.col, max(CASE WHEN c.array_id = p.a THEN c.token END) AS ta, max(CASE WHEN c.array_id = p.b THEN c.token END) AS tb
  FROM pairs p JOIN few c ON c.group_id = p.group_id AND c.array_id IN (p.a, p.b) GROUP BY ALL),
f AS (SELECT *, min(CASE WHEN ta = tb THEN col END) OVER w AS fes, count(ta) OVER o AS ra, count(tb) OVER o AS rb FROM cells
  WINDOW w AS (PARTITION BY group_id, a, b), o AS (PARTITION BY group_id, a, b ORDER BY col)),
g AS (SELECT *, coalesce(col >= fes, false) AS older FROM f),
counts AS (SELECT group_id, a, b, any_value(fes) AS fes, count(*) FILTER (NOT older AND ta IS NOT NULL) AS gains_a, count(*) FILTER (NOT older AND tb IS NOT NULL) AS gains_b,
  count(*) FILTER (older AND ta IS NOT NULL) AS keeps_a, count(*) FILTER (older AND tb IS NOT NULL) AS keeps_b FROM g GROUP BY ALL),
runs_a AS (SELECT group_id, a, b, string_agg(n::VARCHAR, ',' ORDER BY ra) AS runs FROM (SELECT group_id, a, b, ra, count(*) AS n FROM g WHERE older AND ta IS NULL GROUP BY ALL) GROUP BY ALL),
runs_b AS (SELECT group_id, a, b, string_agg(n::VARCHAR, ',' ORDER BY rb) AS runs FROM (SELECT group_id, a, b, rb, count(*) AS n FROM g WHERE older AND tb IS NULL GROUP BY ALL) GROUP BY ALL)"""
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within blocks of 20 ids only, as in the SQL twin; `pair_distances` takes all pairs of a group."""
    few = views.event_arrays(spark, sf_dir).withColumn("group_id", F.concat_ws("_", "group_id", F.floor(F.col("array_id") / 20).cast("string"))).withColumn("col", 99 - F.col("token"))
    ids = few.select("group_id", "array_id").distinct()
    pairs = ids.withColumnRenamed("array_id", "a").join(ids.withColumnRenamed("array_id", "b"), "group_id").where(F.col("a") > F.col("b"))
    return arrays.pair_counts(few, pairs)


@query(PAIRS + " SELECT group_id, a, b, fes, gains_a, gains_b, keeps_a, keeps_b, coalesce(x.runs, '') AS runs_a, coalesce(y.runs, '') AS runs_b FROM counts LEFT JOIN runs_a x USING (group_id, a, b) LEFT JOIN runs_b y USING (group_id, a, b)")
def pair_counts_and_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _pairs(spark, sf_dir).select("group_id", "a", "b", "fes", "gains_a", "gains_b", "keeps_a", "keeps_b", text("runs_a"), text("runs_b"))


#: All pairs of each group; each side's time is where t times the derivative of its log likelihood changes its sign.
DISTANCES = (
    "WITH RECURSIVE "
    + views.EVENT_ARRAYS_SQL
    + f""",
whole AS (SELECT group_id, array_id, token, 99 - token AS col FROM arrays),
ids AS (SELECT DISTINCT group_id, array_id FROM whole),
pairs AS (SELECT x.group_id, x.array_id AS x, y.array_id AS y FROM ids x JOIN ids y ON x.group_id = y.group_id AND x.array_id <> y.array_id),
both_cells AS (SELECT p.*, c.col, c.token AS tx, NULL::INT AS ty FROM pairs p JOIN whole c ON c.group_id = p.group_id AND c.array_id = p.x
  UNION ALL SELECT p.*, c.col, NULL::INT, c.token FROM pairs p JOIN whole c ON c.group_id = p.group_id AND c.array_id = p.y),
cells AS (SELECT group_id, x, y, col, max(tx) AS tx, max(ty) AS ty FROM both_cells GROUP BY ALL),
f AS (SELECT *, min(CASE WHEN tx = ty THEN col END) OVER (PARTITION BY group_id, x, y) AS fes, count(tx) OVER (PARTITION BY group_id, x, y ORDER BY col) AS run FROM cells),
o AS (SELECT *, coalesce(col >= fes, false) AS older FROM f),
sides AS (SELECT group_id, x, y, count(*) FILTER (NOT older AND tx IS NOT NULL) AS g, count(*) FILTER (older AND tx IS NOT NULL) AS k,
  count(DISTINCT run) FILTER (older AND tx IS NULL) AS n, count(*) FILTER (older AND tx IS NULL) AS s FROM o GROUP BY ALL),
model AS (SELECT {fn.SIMPLE_DISTANCE["gain"]}::DOUBLE / ({fn.SIMPLE_DISTANCE["loss"]}::DOUBLE * {fn.SIMPLE_DISTANCE["alpha"]}::DOUBLE) AS rate, {fn.SIMPLE_DISTANCE["loss"]}::DOUBLE AS loss, 1 / {fn.SIMPLE_DISTANCE["alpha"]}::DOUBLE AS q),
bisected AS (
  SELECT g, k, n, s, 0 AS i, ln(1e-40::DOUBLE) AS low, ln(1e6::DOUBLE) AS high FROM (SELECT DISTINCT g, k, n, s FROM sides)
  UNION ALL SELECT g, k, n, s, i + 1, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END FROM (
    SELECT *, g - t * rate - z * k + n * CASE WHEN z < 1e-5 THEN 1 - z / 2 WHEN z > 700 THEN 0 ELSE z / (exp(z) - 1) END + (s - n) * q * z * exp(-z) / (1 - q * exp(-z)) > 0 AS up
    FROM (SELECT *, exp((low + high) / 2) AS t, loss * exp((low + high) / 2) AS z FROM bisected, model) WHERE i < 70)),
times AS (SELECT g, k, n, s, g = 0 AND n = 0 AS none, exp((low + high) / 2) AS t FROM bisected WHERE i = 70)"""
)


@query(DISTANCES + f" SELECT group_id, greatest(x, y) AS a, least(x, y) AS b, round(CASE WHEN bool_and(none) THEN {fn.MIN_BRANCH}::DOUBLE ELSE least({fn.MAX_BRANCH}::DOUBLE, greatest({fn.MIN_BRANCH}::DOUBLE, sum(t))) END, 7) AS distance FROM sides JOIN times USING (g, k, n, s) GROUP BY group_id, greatest(x, y), least(x, y)")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.group_distances(_columns(spark, sf_dir)).withColumn("distance", F.round("distance", 7))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_arrays(spark, sf_dir).withColumn("col", 99 - F.col("token"))


@query()
def upgma_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.array_trees(_columns(spark, sf_dir))


@query()
def neighbour_joining_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.array_trees(_columns(spark, sf_dir), method="nj")


NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part)"


@query(f"WITH {NAMES} SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name) AS distance FROM names x JOIN names y ON x.name < y.name WHERE levenshtein(x.name, y.name) <= 4")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.similar_pairs(views.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), "name", 4)


@query(
    f"""WITH RECURSIVE {NAMES},
e AS (SELECT x.name AS a, y.name AS b FROM names x, names y WHERE levenshtein(x.name, y.name) <= 4),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS name, min(b) AS representative FROM r GROUP BY ALL"""
)
def single_link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.single_linkage(views.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), "name", 4)


def _greedy(items: str, near: str) -> str:
    """Clusters by a scan: an item joins the earliest cluster that an earlier item near it is in, or begins one.

    items: key, item, i (its place); near: a condition on x and an earlier y. chosen has key, item, i and head, the place
    of its cluster's first item.
    """
    return f"""items AS ({items}),
close AS (SELECT x.key, x.i, list(y.i) FILTER (y.i IS NOT NULL) AS js FROM items x LEFT JOIN items y ON y.key = x.key AND y.i < x.i AND {near} GROUP BY ALL),
scan AS (SELECT key, 0::BIGINT AS i, []::BIGINT[] AS heads FROM (SELECT DISTINCT key FROM items) UNION ALL
  SELECT s.key, s.i + 1, list_append(s.heads, coalesce(list_min([s.heads[j] FOR j IN c.js]), s.i + 1)) FROM scan s JOIN close c ON c.key = s.key AND c.i = s.i + 1),
done AS (SELECT key, arg_max(heads, i) AS heads FROM scan GROUP BY ALL),
chosen AS (SELECT t.key, t.item, t.i, d.heads[t.i] AS head FROM items t JOIN done d USING (key))"""


_LEADERS = _greedy("SELECT p_brand AS key, p_name AS item, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey), p_name) AS i FROM part GROUP BY p_brand, p_name", "levenshtein(x.item, y.item) <= 4")
_OVERLAPS = _greedy("SELECT group_id AS key, array_id AS item, row_number() OVER (PARTITION BY group_id ORDER BY array_id) AS i, list(token) AS tokens FROM arrays GROUP BY group_id, array_id", "list_has_any(x.tokens, y.tokens)")


@query(f"WITH RECURSIVE {_LEADERS} SELECT c.key AS repeat, c.item AS name, h.item AS representative FROM chosen c JOIN chosen h ON h.key = c.key AND h.i = c.head")
def greedy_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("repeat"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return cluster.greedy_leader(names, "name", 4)


@query(
    "WITH RECURSIVE "
    + views.EVENT_ARRAYS_SQL
    + """,
e AS (SELECT DISTINCT x.group_id, x.array_id AS a, y.array_id AS b FROM arrays x JOIN arrays y USING (group_id, token)),
r AS (SELECT * FROM e UNION SELECT r.group_id, r.a, e.b FROM r JOIN e ON r.group_id = e.group_id AND r.b = e.a)
SELECT group_id, a AS array_id, min(b) AS component FROM r GROUP BY ALL"""
)
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.overlap_components(views.event_arrays(spark, sf_dir))


@query("WITH RECURSIVE " + views.EVENT_ARRAYS_SQL + "," + _OVERLAPS + " SELECT key AS group_id, item AS array_id, 'g_' || (dense_rank() OVER (PARTITION BY key ORDER BY head) - 1) AS cluster FROM chosen")
def greedy_overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.greedy_overlap(views.event_arrays(spark, sf_dir))


LETTERS, BASES = "bdefhijklmnopqrsuvwxyzacgt .", "ACGTACGTACGTACGTACGTACACGTAC"
DNA = f"dna AS (SELECT doc_id, translate(text, '{LETTERS}', '{BASES}') AS seq FROM documents)"


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.translate("text", LETTERS, BASES).alias("seq"))


@query(f"WITH {DNA} SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM dna")
def reverse_complement_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("doc_id", fn.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {DNA} SELECT doc_id, translate(reverse(regexp_replace(seq, '[^ACGTN]', 'N', 'g')), 'ACGT', 'TGCA') AS rc FROM dna")
def reverse_complement_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dna(spark, sf_dir).select("doc_id", fn.reverse_complement_n(F.col("seq")).alias("rc"))


@query("SELECT doc_id, upper(replace(regexp_replace(text, '[ \n\r\t]', '', 'g'), 'ß', 'ss')) AS seq FROM documents")
def dna_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", fn.clean_dna(F.col("text")).alias("seq"))


@query("SELECT event_id, regexp_replace(event_type || '_' || user_id || '_' || event_id, '_[^_]*$', '') AS accession FROM events")
def accession_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return views.table(spark, sf_dir, "events").select("event_id", fn.accession(name).alias("accession"))


@query("WITH c AS (SELECT o_custkey AS group_id, o_orderpriority AS type, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT group_id, arg_max(type, {'n': n, 'f': -first}) AS type, count(type) AS n_types FROM c GROUP BY ALL")
def majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.majority_type(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("type")))


LOCATION = "CASE n_nationkey % 4 WHEN 0 THEN 'Chromosome ' || n_name WHEN 1 THEN 'plasmid p1' WHEN 2 THEN 'contig' END"


@query(f"WITH l AS (SELECT n_regionkey AS group_id, lower({LOCATION}) AS x FROM nation), c AS (SELECT group_id, count(*) FILTER (contains(x, 'chromosome')) AS c, count(*) FILTER (contains(x, 'plasmid') AND NOT contains(x, 'chromosome')) AS p FROM l GROUP BY ALL) SELECT group_id, CASE WHEN c > 0 AND p > 0 THEN 'c + p' WHEN c > 0 THEN 'c' WHEN p > 0 THEN 'p' ELSE 'not available' END AS label FROM c")
def location_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    location = F.when(k == 0, F.concat(F.lit("Chromosome "), "n_name")).when(k == 1, "plasmid p1").when(k == 2, "contig")
    return arrays.location_label(views.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("group_id"), location.alias("location")))


@query("SELECT c_nationkey AS group_id, string_agg(DISTINCT c_mktsegment, ' + ' ORDER BY c_mktsegment) AS kingdom FROM customer GROUP BY ALL")
def joined_kingdoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.joined_values(views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_mktsegment").alias("kingdom")), "kingdom")


NT = "WITH RECURSIVE " + views.NATION_TREE_SQL
NT_ABOVE = NT + """,
above AS (SELECT node_id, node_id AS ancestor, 0.0::DOUBLE AS distance, 0 AS steps FROM tree
  UNION ALL SELECT a.node_id, t.parent_id, a.distance + t.branch_length, a.steps + 1 FROM above a JOIN tree t ON a.ancestor = t.node_id WHERE t.parent_id IS NOT NULL),
tips AS (SELECT node_id FROM tree WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL))"""


@query(NT_ABOVE + " SELECT * FROM above")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ancestors(views.nation_tree(spark, sf_dir))


@query(NT_ABOVE + " SELECT sum(branch_length) AS total_length, min(branch_length) AS min_length, max(branch_length) AS max_length, max(h.height) AS height, max(h.n) AS n_leaves, bool_and(h.one = 1) AS ultrametric FROM tree, (SELECT max(distance) AS height, count(*) AS n, count(DISTINCT distance) AS one FROM above JOIN tips USING (node_id) WHERE ancestor = 'root') h WHERE parent_id IS NOT NULL")
def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.metrics(views.nation_tree(spark, sf_dir))


SUPPLIERS = NT_ABOVE.replace("'c' || c_custkey AS node_id, 'n' || c_nationkey AS parent_id, (c_custkey % 7 + 1)", "'c' || s_suppkey AS node_id, 'n' || s_nationkey AS parent_id, (s_suppkey % 7 + 1)").replace("FROM customer", "FROM supplier")


@query(SUPPLIERS + " SELECT x.node_id AS a, y.node_id AS b, min(x.distance + y.distance) AS distance FROM above x JOIN above y USING (ancestor) JOIN tips s ON s.node_id = x.node_id JOIN tips t ON t.node_id = y.node_id WHERE x.node_id > y.node_id GROUP BY ALL")
def leaf_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.nation_tree(spark, sf_dir, "supplier")
    return tree.leaf_distances(t, tree.leaves(t))


@query(NT_ABOVE + " SELECT ancestor AS node_id, count(*) AS n_leaves FROM above JOIN tips USING (node_id) GROUP BY ALL")
def leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaf_counts(views.nation_tree(spark, sf_dir))


@query(NT + " SELECT node_id, parent_id, CASE WHEN parent_id IS NULL THEN 0.0 ELSE coalesce(branch_length, 0) + 0.25 END::DOUBLE AS branch_length, depth FROM tree")
def extended_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.extended(views.nation_tree(spark, sf_dir), 0.25)


@query("WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 9) AS share FROM c")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.value_shares(views.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").withColumn("share", F.round("share", 9))


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, p_type) AS INT) AS place FROM c")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.category_counts(views.table(spark, sf_dir, "part"), "p_type").withColumn("place", F.col("place").cast("int"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY ALL")
def two_way_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.two_way_counts(views.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS low, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY ALL")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.quartiles(views.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)")
def quantile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.below_quantile(views.table(spark, sf_dir, "orders"), "o_totalprice", 0.95).select("o_orderkey", "o_totalprice")


@query("WITH d AS (SELECT (c_acctbal - 4500) / 100 AS d FROM customer) SELECT threshold, round(count(*) FILTER (abs(d) > threshold) / count(*), 9) AS decided, CASE WHEN count(*) FILTER (abs(d) > threshold) > 0 THEN round(count(*) FILTER (d > threshold) / count(*) FILTER (abs(d) > threshold), 9) END AS precision FROM d, (VALUES (0.0::DOUBLE), (5.0), (10.0), (40.0), (1000.0)) t(threshold) GROUP BY ALL")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "customer").select(((F.col("c_acctbal") - 4500) / 100).alias("d"))
    thresholds = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (40.0,), (1000.0,)], "threshold double")
    return analysis.threshold_sweep(rows, "d", thresholds).select("threshold", F.round("decided", 9).alias("decided"), F.round("precision", 9).alias("precision"))


@query("WITH f AS (SELECT n_nationkey AS group_id, avg(c_acctbal) / 100 AS lnl FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), b AS (SELECT s_nationkey AS group_id, avg(s_acctbal) / 100 AS lnl FROM supplier GROUP BY ALL), j AS (SELECT f.group_id, f.lnl - b.lnl AS d FROM f LEFT JOIN b USING (group_id)) SELECT group_id, round(d, 6) AS difference, CASE WHEN d < -5 THEN 'reverse' WHEN d > 5 THEN 'forward' ELSE 'nd' END AS recommendation, CASE WHEN d < -5 THEN 'Reverse' WHEN d > 5 THEN 'Forward' ELSE 'ND' END AS orientation, CASE WHEN d < -5 THEN 'b' ELSE 'f' END AS run FROM j")
def orientation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "supplier")
    f = c.groupBy(F.col("c_nationkey").alias("group_id")).agg((F.avg("c_acctbal") / 100).alias("lnl_bdm")).withColumn("run", F.lit("f"))
    b = s.groupBy(F.col("s_nationkey").alias("group_id")).agg((F.avg("s_acctbal") / 100).alias("lnl_bdm")).withColumn("run", F.lit("b"))
    return orient.compare(f, b).select("group_id", F.round("difference", 6).alias("difference"), "recommendation", "orientation", "run")


@query("WITH c AS (SELECT o_custkey AS group_id, list(DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS codes FROM orders GROUP BY ALL) SELECT group_id, CASE WHEN list_contains(codes, 1) AND list_contains(codes, 2) THEN 3 WHEN list_contains(codes, 1) THEN 1 WHEN list_contains(codes, 2) THEN 2 ELSE 3 END AS code FROM c")
def group_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    codes = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.collect_set(code).alias("codes"))
    return codes.select("group_id", fn.consensus(F.col("codes")).alias("code"))


@query("WITH x AS (SELECT l_linenumber::BIGINT AS k, 1 + l_discount * 20 AS alpha, l_tax + 0.01 AS loss FROM lineitem) SELECT k, round(alpha, 6) AS alpha, round(loss, 6) AS loss, round(any_value(CASE WHEN alpha = 1 THEN CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END ELSE pow(1 - 1 / alpha, k - 1) / alpha END), 9) AS geometric, round(any_value(greatest(1e-40, (1 - exp(-loss * 1.5)) / alpha * pow(1 - exp(-loss * 1.5) / alpha, k - 1))), 9) AS block FROM x GROUP BY k, round(alpha, 6), round(loss, 6)")
def block_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), (1 + F.col("l_discount") * 20).alias("a"), (F.col("l_tax") + 0.01).alias("l"))
    g, b = fn.geometric(F.col("k"), F.col("a")), fn.block_likelihood(F.col("k"), F.col("l"), F.col("a"), F.lit(1.5))
    return x.groupBy("k", F.round("a", 6).alias("alpha"), F.round("l", 6).alias("loss")).agg(F.round(F.first(g), 9).alias("geometric"), F.round(F.first(b), 9).alias("block"))


@query("WITH x AS (SELECT c_custkey, 0.05 + c_custkey % 7 / 10.0 AS a, 0.1 + c_custkey % 5 / 4.0 AS b, 0.2 * (c_custkey % 9 + 1) AS t FROM customer), y AS (SELECT *, exp(-(a + b) * t) AS e FROM x) SELECT c_custkey, round((b + a * e) / (a + b), 9) AS p00, round(a * (1 - e) / (a + b), 9) AS p01, round(b * (1 - e) / (a + b), 9) AS p10, round((a + b * e) / (a + b), 9) AS p11, round(CASE WHEN -t < -0.693 THEN ln(1 - exp(-t)) ELSE ln(1 - exp(-t)) END, 9) AS log1mexp FROM y")
def chain_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a, b, t = 0.05 + k % 7 / 10.0, 0.1 + k % 5 / 4.0, 0.2 * (k % 9 + 1)
    return views.table(spark, sf_dir, "customer").select("c_custkey", *(F.round(fn.transition(a, b, t, p, c), 9).alias(f"p{p}{c}") for p in (0, 1) for c in (0, 1)), F.round(fn.log1mexp(-t), 9).alias("log1mexp"))


@query("SELECT c_custkey, round((c_custkey % 30) * ln(2.5) - 2.5 - lgamma(c_custkey % 30 + 1), 8) AS ln_pmf FROM customer")
def poisson_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", F.round(fn.poisson_log(F.col("c_custkey") % 30, F.lit(2.5)), 8).alias("ln_pmf"))


@query("SELECT user_id, to_json(map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type))) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("SELECT 2 * count(*) AS rows, count(DISTINCT c_custkey) AS groups FROM customer")
def protocol_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    both = orient.merged_protocols(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_acctbal"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("c_custkey").alias("groups"))


@query(EV + " SELECT group_id, array_id, count(*) AS n FROM arrays GROUP BY ALL HAVING count(*) >= 3 AND (group_id, array_id) IN (SELECT group_id, array_id FROM arrays WHERE pos = 0 AND token > 50)")
def young_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Events(spark, sf_dir).arrays
    young = a.where((F.col("pos") == 0) & (F.col("token") > 50)).select("group_id", "array_id")
    return a.join(young, ["group_id", "array_id"], "left_semi").groupBy("group_id", "array_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)
