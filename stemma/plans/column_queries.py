"""Queries of column functions, filters, joins and counts over the driver's tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import views
from stemma.functions import scalar as fn
from stemma.operators import analysis, arrays, filters, orient, reconstruct, tree, visual

from .event_queries import BLOCKS, EV, ORDER, STATES, Events
from .file_queries import BASES, LETTERS, PATHS, _nations
from .table_queries import BR, PACKED, RAW, _raw

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- columns


@query("SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, '-', o_orderpriority, '-', substr(o_orderpriority, 1, 1)], lambda x: x <> '-'), '|') AS tokens, 3 AS n FROM orders")
def arrays_without_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fn.without_gaps(F.array("o_orderstatus", F.lit("-"), "o_orderpriority", F.lit("-"), F.substring("o_orderpriority", 1, 1)))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(kept, "|").alias("tokens"), F.size(kept).alias("n"))


@query("SELECT 'file_' || n_name AS group_id, 'array ' || n_nationkey AS array_id, replace('CAS-Type' || n_regionkey, 'CAS-Type', '') AS type FROM nation")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's name from its path, an array's from its header, a type's label."""
    n = views.table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/a.b/file_"), "n_name", F.lit(".x.fa"))
    return n.select(fn.group_name(path).alias("group_id"), fn.header_name(F.concat(F.lit(" array "), F.col("n_nationkey").cast("string"), F.lit(" , more, of it"))).alias("array_id"), fn.clean_label(F.concat(F.lit("CAS-Type"), F.col("n_regionkey").cast("string"))).alias("type"))


@query("WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'block' ELSE 'independent' END AS model, 0.1 + c_custkey % 7 AS rho, 1.0 + c_custkey % 4 / 2.0 AS alpha, 5.0 + c_custkey % 30 AS len FROM customer) SELECT k, round(rho * alpha, 9) AS per_token, round(rho * alpha * len, 9) AS insertion, round(CASE model WHEN 'block' THEN rho * len * alpha ELSE rho * len END, 9) AS gain, round(CASE model WHEN 'block' THEN rho / (len * alpha) ELSE rho / len END, 9) AS loss, round(log10(rho), 9) AS log_rho FROM x")
def rate_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for a token, of insertions, and those that keep the mean length; on a log scale."""
    from stemma.operators.fit import derived_rates

    k = F.col("c_custkey")
    model, rho, alpha, length = F.when(k % 2 == 0, "block").otherwise("independent"), 0.1 + k % 7, 1.0 + k % 4 / 2.0, 5.0 + k % 30
    rates = derived_rates(rho, alpha, length)
    out = {"per_token": rates["per_token"], "insertion": rates["insertion"], "gain": fn.estimated_gain(model, rho, length, alpha), "loss": fn.constant_length_loss(model, rho, length, alpha), "log_rho": F.log10(rho)}
    return views.table(spark, sf_dir, "customer").select(k.alias("k"), *(F.round(c, 9).alias(n) for n, c in out.items()))


@query("SELECT s_suppkey AS id, s_name AS name, round(s_acctbal - s_suppkey, 6) AS d_balance FROM supplier")
def renamed_with_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns under other names and back, and an estimate's difference from the truth."""
    names = {"s_suppkey": "id", "s_name": "name"}
    s = analysis.renamed(views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), names)
    again = analysis.renamed(analysis.renamed(s, names, back=True), names)
    return analysis.delta_columns(again, {"d_balance": ("s_acctbal", "id")}).select("id", "name", F.round("d_balance", 6).alias("d_balance"))


STRAND = "strands AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS mine, o_orderkey % 3 + 1 AS other, CASE WHEN o_orderkey % 5 < 2 THEN 'reverse' WHEN o_orderkey % 5 = 2 THEN 'forward' ELSE 'nd' END AS recommendation FROM orders)"
AGREE = "CASE WHEN mine = 3 AND other = 3 THEN 'none' WHEN mine = 3 THEN 'only other' WHEN other = 3 THEN 'only mine' WHEN mine = other THEN 'agree' ELSE 'disagree' END"


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(status == "F", 1).when(status == "O", 2).otherwise(3).alias("mine"), (k % 3 + 1).alias("other"), F.when(k % 5 < 2, "reverse").when(k % 5 == 2, "forward").otherwise("nd").alias("recommendation"))


@query(f"WITH {STRAND} SELECT o_orderkey, CAST(CASE WHEN recommendation = 'reverse' AND mine = 1 THEN 2 WHEN recommendation = 'reverse' AND mine = 2 THEN 1 ELSE mine END AS INT) AS strand FROM strands")
def flipped_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orient.by_strand(_strands(spark, sf_dir).withColumnRenamed("mine", "strand")).select("o_orderkey", "strand")


@query(f"WITH {STRAND} SELECT {AGREE} AS relation, count(*) AS n FROM strands GROUP BY ALL")
def array_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two predictions relate, counted by array."""
    return _strands(spark, sf_dir).groupBy(fn.agreement(F.col("mine"), F.col("other")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


_CONSENSUS = "CASE WHEN list_contains({0}, 1) AND list_contains({0}, 2) THEN 3 WHEN list_contains({0}, 1) THEN 1 WHEN list_contains({0}, 2) THEN 2 ELSE 3 END"


@query(f"WITH {STRAND}, c AS (SELECT o_custkey, list(mine) AS m, list(other) AS o FROM strands GROUP BY ALL), g AS (SELECT {_CONSENSUS.format('m')} AS mine, {_CONSENSUS.format('o')} AS other FROM c) SELECT {AGREE} AS relation, count(*) AS n FROM g GROUP BY ALL")
def group_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by group: first each prediction's consensus over a group's arrays."""
    codes = _strands(spark, sf_dir).groupBy("o_custkey").agg(F.collect_set("mine").alias("m"), F.collect_set(F.col("other").cast("int")).alias("o"))
    return codes.groupBy(fn.agreement(fn.consensus(F.col("m")), fn.consensus(F.col("o"))).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, n_regionkey AS low, n_nationkey AS high FROM nation")
def unnested_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation").select("n_name", F.struct(F.col("n_regionkey").alias("low"), F.col("n_nationkey").alias("high")).alias("o"))
    return n.select("n_name", "o.*")


@query("SELECT n_regionkey AS r, string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) AS entries FROM nation GROUP BY ALL")
def inverted_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from names to keys turned into maps from keys to names."""
    m = views.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    entries = F.array_sort(F.map_entries(fn.invert_map(F.col("m"))))
    return m.select("r", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",").alias("entries"))


@query("SELECT c_custkey AS k, round(CASE WHEN c_custkey % 4 = 0 THEN 'infinity'::DOUBLE ELSE -ln((c_custkey % 97 + 1) / 98.0) / (c_custkey % 4) END, 9) AS wait, round(2.0 / ((c_custkey % 20 + 2) * (c_custkey % 20 + 1)), 9) AS coalescence FROM customer")
def waiting_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential draws from uniform ones, infinite for rate 0, and mean times of the coalescent."""
    k = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(k.alias("k"), F.round(fn.exponential((k % 97 + 1) / 98.0, k % 4), 9).alias("wait"), F.round(fn.coalescent_length(k % 20 + 2), 9).alias("coalescence"))


@query("WITH s AS (SELECT s_suppkey AS k, 0.5 + s_suppkey % 7 AS r FROM supplier), t AS (SELECT k, r, i, (i + 1) * (i + 2) / (2 * r) AS c FROM s, unnest(range(0, 61)) u(i)), p AS (SELECT k, i, c / exp(sum(ln(c + 1)) OVER (PARTITION BY k ORDER BY i)) AS p FROM t) SELECT k, round(sum(i * p), 6) AS mean, round(sum(i * i * p) - pow(sum(i * p), 2), 6) AS variance FROM p GROUP BY ALL")
def fragment_length_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of the fragment model's stationary length."""
    k = F.col("s_suppkey")
    m = fn.fragment_moments(0.5 + k % 7, 60)
    return views.table(spark, sf_dir, "supplier").select(k.alias("k"), m.alias("m")).select("k", F.round("m.mean", 6).alias("mean"), F.round("m.variance", 6).alias("variance"))


@query("WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT p, n, CAST(coalesce(list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], p), 4) AS INT) AS place FROM c")
def labels_in_given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", analysis.explicit_order(F.col("p"), ["5-LOW", "1-URGENT", "3-MEDIUM"]).cast("int"))


@query("WITH r AS (SELECT c_nationkey, avg(c_acctbal) / 100 AS d FROM customer GROUP BY ALL), b AS (SELECT floor(d)::DOUBLE AS bin, count(*) AS n FROM r GROUP BY ALL) SELECT bin, n, round(n / sum(n) OVER (), 9) AS share FROM b")
def ratio_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood differences in bins of width 1, as shares of all."""
    r = views.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 100).alias("d"))
    return analysis.histogram(r, "d", 1.0).select(F.col("bin").cast("double").alias("bin"), "n", F.round("share", 9).alias("share"))


# --- filters


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity::INT % 6 >= 4")
def enough_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").withColumn("evidence_level", F.col("l_quantity").cast("int") % 6)
    return filters.by_evidence(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("WITH g AS (SELECT n_name, n_nationkey::BIGINT * 10 AS b, n_regionkey::BIGINT * 70 AS s, n_nationkey FROM nation), d AS (SELECT *, least(abs(b - s), abs(b - s - 40), abs(b + 25 - s), abs(b + 25 - s - 40)) AS distance FROM g) SELECT n_name, distance FROM d WHERE (distance <= 20 AND distance <> 0) OR n_nationkey % 6 = 0")
def near_genes_or_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays near a gene or of a known type; a distance of 0 doesn't count as near."""
    k = F.col("n_nationkey").cast("long")
    genes = F.array(F.struct((F.col("n_regionkey").cast("long") * 70).alias("start"), F.lit(40).cast("long").alias("length")))
    rows = views.table(spark, sf_dir, "nation").select("n_name", (k * 10).alias("array_start"), (k * 10 + 25).alias("array_end"), genes.alias("genes"), F.array(F.when(k % 6 == 0, "I")).alias("types"))
    return filters.near_genes_or_typed(filters.with_gene_distance(rows), 20).select("n_name", "distance")


NAMED = "named AS (SELECT c_custkey AS array_id FROM customer WHERE c_acctbal < 3000)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 3000).select(F.col("c_custkey").alias("array_id"))


@query(BR + f", {NAMED} SELECT group_id, array_id, pos, token FROM arrays ANTI JOIN named USING (array_id)")
def arrays_without_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_arrays(views.brand_arrays(spark, sf_dir), _named(spark, sf_dir))


@query(BR + f", {NAMED} SELECT group_id, array_id, pos, token FROM arrays SEMI JOIN named USING (array_id)")
def arrays_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.only_arrays(views.brand_arrays(spark, sf_dir), _named(spark, sf_dir))


@query("WITH c AS (SELECT o_custkey, list(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS codes FROM orders GROUP BY ALL) SELECT o_custkey, len(codes)::INT AS n FROM c WHERE NOT list_contains(codes, 3)")
def arrays_without_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    codes = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(code).alias("codes"))
    return filters.without_value(codes, "codes").select("o_custkey", F.size("codes").alias("n"))


@query(STATES + BLOCKS + " SELECT DISTINCT group_id FROM arrays SEMI JOIN blocks USING (group_id)")
def groups_with_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return filters.with_losses(e.arrays.select("group_id").distinct(), reconstruct.loss_blocks(e.with_parents, e.tree, e.rank))


# --- joins


@query("WITH f AS (SELECT c_nationkey AS k, avg(c_acctbal) / 100 AS l FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS k, avg(s_acctbal) / 100 AS l FROM supplier GROUP BY ALL), d AS (SELECT f.k, CASE WHEN f.l - b.l < -5 THEN 'supplier' ELSE 'customer' END AS side FROM f LEFT JOIN b USING (k)) SELECT c_nationkey AS group_id, c_name AS name FROM customer JOIN d ON k = c_nationkey AND side = 'customer' UNION ALL SELECT s_nationkey, s_name FROM supplier JOIN d ON k = s_nationkey AND side = 'supplier'")
def rows_of_chosen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a group from the run that its decision names."""
    c, s = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "supplier")
    f = c.groupBy(F.col("c_nationkey").alias("group_id")).agg((F.avg("c_acctbal") / 100).alias("lnl_bdm"))
    b = s.groupBy(F.col("s_nationkey").alias("group_id")).agg((F.avg("s_acctbal") / 100).alias("lnl_bdm"))
    return orient.chosen_rows(orient.compare(f, b), c.select(F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("name")), s.select(F.col("s_nationkey").alias("group_id"), F.col("s_name").alias("name")))


@query(f"WITH r AS (SELECT n_nationkey, translate(n_name, '{LETTERS}_0123456789', '{BASES}ACGTACGTACG') AS repeat FROM nation), o AS (SELECT *, translate(reverse(repeat), 'ACGT', 'TGCA') AS other FROM r) SELECT n_nationkey, CASE WHEN repeat <= other THEN '+' ELSE '-' END AS strand, least(repeat, other) AS repeat FROM o")
def repeats_in_one_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeat and its reverse complement under one name."""
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", F.translate("n_name", LETTERS + "_0123456789", BASES + "ACGTACGTACG").alias("repeat"))
    return orient.fixed_repeats(n)


@query("WITH s AS (SELECT c_custkey AS k, c_acctbal AS truth FROM customer), r AS (SELECT o_custkey AS k, max(o_totalprice) AS estimate FROM orders GROUP BY ALL) SELECT k, truth, estimate FROM s JOIN r USING (k)")
def truth_with_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulations beside their reconstructions, where both are."""
    s = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("truth"))
    return s.join(views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("estimate")), "k", "inner")


ACTIONS = """, copies AS (SELECT group_id, array_id % 40 AS leaf, array_id, tokens FROM packed),
acts AS (SELECT group_id, leaf, count(*) AS n, CASE WHEN count(*) = 1 THEN 'keep' WHEN count(DISTINCT tokens) = 1 THEN 'split' ELSE 'prune' END AS action FROM copies GROUP BY ALL),
leaves AS (SELECT DISTINCT group_id, k AS leaf FROM packed, unnest(range(45)) u(k))"""


def _leaf_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.brand_arrays(spark, sf_dir)
    # Several arrays of one name: what Spark packs by (group, array) is told apart by its first token here.
    kinds = arrays.packed(a).select("group_id", (F.col("array_id") % 40).alias("node_id"), "tokens")
    facts = kinds.groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tokens").alias("kinds"))
    return a.select("group_id").distinct().withColumn("node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(44).cast("long")))).join(facts, ["group_id", "node_id"], "left")


@query(BR + PACKED + ACTIONS + " SELECT group_id, leaf AS node_id, coalesce(n, 0) AS n, coalesce(action, 'missing') AS action FROM leaves LEFT JOIN acts USING (group_id, leaf)")
def leaf_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a leaf is kept, split into its equal arrays, pruned because they differ, or missing."""
    return _leaf_actions(spark, sf_dir).select("group_id", "node_id", F.coalesce("n", F.lit(0)).alias("n"), arrays.leaf_action(F.col("n"), F.col("kinds")).alias("action"))


@query(BR + PACKED + ACTIONS + " SELECT group_id, 'l' || leaf AS node_id, 'root' AS parent_id, 1.0::DOUBLE AS branch_length FROM acts WHERE action <> 'prune' UNION ALL SELECT group_id, 'l' || leaf || '_' || i, 'l' || leaf, 1e-6::DOUBLE FROM acts, unnest(range(1, n + 1)) u(i) WHERE action = 'split' UNION ALL SELECT DISTINCT group_id, 'root', NULL, 0.0::DOUBLE FROM packed")
def tree_with_leaf_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _leaf_actions(spark, sf_dir).select("group_id", F.concat(F.lit("l"), F.col("node_id").cast("string")).alias("node_id"), F.coalesce("n", F.lit(0)).alias("n"), arrays.leaf_action(F.col("n"), F.col("kinds")).alias("action"))
    t = acts.select("group_id", "node_id", F.lit("root").alias("parent_id"), F.lit(1.0).alias("branch_length"))
    t = t.unionByName(acts.select("group_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("branch_length")).distinct())
    return tree.with_leaf_actions(t, acts)


# --- duplicates


@query(f"WITH {RAW} SELECT group_id, sum(n - 1)::BIGINT AS weighted, count(*) AS tokens FROM (SELECT group_id, token, count(*) AS n FROM raw GROUP BY ALL) WHERE n > 1 GROUP BY ALL")
def weighted_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies beyond the first, over all tokens that have some."""
    d = arrays.duplicate_counts(_raw(spark, sf_dir), "group_id", "token")
    return d.groupBy("group_id").agg(F.sum(F.col("n") - 1).alias("weighted"), F.count(F.lit(1)).alias("tokens"))


FLAGS = "flags AS (SELECT l_orderkey, l_suppkey, l_partkey % 2 = 0 AS sibling_lost, l_partkey % 3 = 0 AS sibling_here, l_partkey % 5 = 0 AS lost_above, l_partkey % 7 < 3 AS left_of_all FROM lineitem)"


@query(f"WITH {FLAGS}, k AS (SELECT *, CASE WHEN sibling_lost THEN 'rearrangement' WHEN sibling_here THEN 'duplication' WHEN lost_above AND left_of_all THEN 'reacquisition' WHEN left_of_all THEN 'independent acquisition' ELSE 'other' END AS kind FROM flags) SELECT l_suppkey AS group_id, kind, count(*) AS n FROM k GROUP BY ALL")
def duplicate_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of duplicate events, counted for each group."""
    part = F.col("l_partkey")
    flags = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group_id"), (part % 2 == 0).alias("sibling_lost"), (part % 3 == 0).alias("sibling_here"), (part % 5 == 0).alias("lost_above"), (part % 7 < 3).alias("left_of_all"))
    return reconstruct.duplicate_classes(flags).groupBy("group_id", "kind").agg(F.count(F.lit(1)).alias("n"))


CANDIDATES = """,
gained AS (SELECT b.group_id, b.node_id, b.token // 10 AS base, b.token, t.depth FROM branch_events b JOIN tree t USING (node_id) WHERE kind = 'gain'),
posted AS (SELECT *, -depth * 1000000 + row_number() OVER (PARTITION BY group_id, depth ORDER BY node_id, token) AS post_ord FROM gained),
counted AS (SELECT group_id, base, count(DISTINCT token) AS n FROM posted GROUP BY ALL),
candidates AS (SELECT p.* FROM posted p JOIN counted c USING (group_id, base) QUALIFY row_number() OVER (PARTITION BY p.group_id, p.base ORDER BY post_ord, token) <= c.n - 1)"""


def _candidates(e: Events) -> DataFrame:
    from pyspark.sql import Window

    gains = e.events.where(F.col("kind") == "gain").join(e.tree.select("node_id", "depth"), "node_id")
    k = F.row_number().over(Window.partitionBy("group_id", "depth").orderBy("node_id", "token"))
    return reconstruct.duplicate_candidates(gains.select("group_id", "node_id", F.floor(F.col("token") / 10).alias("base"), "token", (-F.col("depth") * 1_000_000 + k).alias("post_ord")))


@query(STATES + CANDIDATES + " SELECT group_id, node_id, base::BIGINT AS base, token FROM candidates")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each base token, the first gains in post-order, one fewer than it has copies; ten tokens are one base's."""
    return _candidates(Events(spark, sf_dir)).select("group_id", "node_id", "base", "token")


@query(STATES + CANDIDATES + " SELECT c.group_id, c.younger, c.older FROM closure c ANTI JOIN candidates x ON x.group_id = c.group_id AND x.token = c.younger ANTI JOIN candidates y ON y.group_id = c.group_id AND y.token = c.older")
def order_without_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order without tokens that may have come by duplication."""
    e = Events(spark, sf_dir)
    return reconstruct.without_tokens(e.order, _candidates(e))


@query(STATES + """,
g AS (SELECT group_id, token, count(*) AS n FROM branch_events WHERE kind = 'gain' GROUP BY ALL)
SELECT group_id, sum(n - 1)::BIGINT AS repeated, (count(*) FILTER (n > 1))::BIGINT AS tokens FROM g GROUP BY ALL""")
def repeated_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of a token beyond its first, that is independent ones."""
    e = Events(spark, sf_dir)
    return reconstruct.repeated_gains(e.events)


@query(STATES + """,
lists AS (SELECT group_id, node_id, parent_id, token, row_number() OVER (PARTITION BY group_id, node_id ORDER BY token) AS k FROM branch_states JOIN ranks USING (group_id, token) WHERE state = 0 AND up = 1)
SELECT p.group_id, p.node_id, p.token, count(l.token) AS others FROM lists p LEFT JOIN lists l ON l.group_id = p.group_id AND l.node_id = p.node_id AND l.token <> p.token GROUP BY ALL""")
def losses_with_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of a branch by label, with the number of the others on it."""
    e = Events(spark, sf_dir)
    lost = e.events.where(F.col("kind") == "loss")
    n = lost.groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return lost.join(n, ["group_id", "node_id"]).select("group_id", "node_id", "token", (F.col("n") - 1).alias("others"))


# --- drawing


@query(ORDER + " SELECT group_id, token, rank, (rank - 1) % 12 AS colour FROM ranks")
def order_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return visual.order_graph(e.order, e.rank)[0]


@query(STATES + ", c AS (SELECT group_id, node_id, token FROM branch_events WHERE kind = 'gain' AND token % 4 = 0) SELECT group_id, node_id, token, kind FROM branch_events e WHERE kind = 'gain' AND token % 4 <> 0 AND token % 7 <> 0")
def plain_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains that are neither contradictions nor duplicates."""
    e = Events(spark, sf_dir)
    events = e.events
    gains = events.where(F.col("kind") == "gain")
    return visual.plain_gains(events, gains.where(F.col("token") % 4 == 0), gains.where(F.col("token") % 7 == 0))


@query(EV + " SELECT group_id, array_id, max(length(token::VARCHAR))::INT AS width FROM arrays GROUP BY ALL")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.column_widths(views.event_arrays(spark, sf_dir).withColumn("label", F.col("token").cast("string")), "label", "group_id", "array_id")


@query(PATHS + " SELECT pre_ord, repeat('  ', depth) || node_id AS line FROM placed")
def tree_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma import sinks
    from stemma.sources import readers

    t = readers.tree_nodes(sinks.newick(_nations(spark, sf_dir)))
    return visual.tree_lines(t).join(t.select("node_id", "pre_ord"), "node_id").select("pre_ord", "line")


AGE = PATHS + ", n AS (SELECT p.node_id, count(*) AS n_leaves FROM paths p JOIN paths q ON q.path = p.path OR starts_with(q.path, p.path || '/') JOIN placed t ON t.node_id = q.node_id AND t.is_leaf GROUP BY ALL)"


@query(AGE + " SELECT node_id, n_leaves, CAST(row_number() OVER (ORDER BY n_leaves DESC, pre_ord) AS INT) AS age FROM n JOIN placed USING (node_id)")
def nodes_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from the oldest on: by the leaves below them, then in pre-order."""
    from stemma import sinks
    from stemma.sources import readers

    return tree.by_age(readers.tree_nodes(sinks.newick(_nations(spark, sf_dir)))).select("node_id", "n_leaves", "age")


@query(STATES + """,
leaves_below AS (SELECT p.node_id, count(*) AS n FROM (SELECT node_id, node_id AS leaf FROM tree WHERE depth = 3 UNION ALL SELECT t.parent_id, t.node_id FROM tree t WHERE t.depth = 3 UNION ALL SELECT q.parent_id, t.node_id FROM tree t JOIN tree q ON q.node_id = t.parent_id WHERE t.depth = 3 UNION ALL SELECT 'root', node_id FROM tree WHERE depth = 3) p GROUP BY ALL),
gained AS (SELECT b.group_id, b.token, l.n, t.depth, b.node_id FROM branch_events b JOIN leaves_below l USING (node_id) JOIN tree t USING (node_id) WHERE kind = 'gain'),
firsts AS (SELECT * FROM gained QUALIFY row_number() OVER (PARTITION BY group_id, token ORDER BY n DESC, node_id) = 1)
SELECT group_id, token, CAST(row_number() OVER (PARTITION BY group_id ORDER BY n DESC NULLS LAST, node_id, rank, token) AS INT) AS place FROM ranks LEFT JOIN firsts USING (group_id, token)""")
def age_sorted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the age of the node that gained them first, then by the order of tokens."""
    e = Events(spark, sf_dir)
    return visual.age_sorted(e.events, e.tree, e.rank)


# --- simulations


@query("WITH a AS (SELECT DISTINCT c_nationkey AS n_leaves FROM customer), b AS (SELECT r_regionkey AS gain FROM region) SELECT CAST(row_number() OVER (ORDER BY n_leaves, gain) - 1 AS BIGINT) AS sim_id, n_leaves, gain, CAST(k AS INT) AS run FROM a, b, unnest(range(3)) u(k)".replace("SELECT CAST(row_number()", "SELECT CAST(dense_rank()"))
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of two parameters, numbered in order, three runs each."""
    from stemma.operators import simulate

    leaves = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_leaves")).distinct()
    gains = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("gain"))
    return simulate.repeated(simulate.grid_of(leaves, gains), 3)


@query("SELECT c_custkey AS sim_id, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE 1.5 END::DOUBLE AS gain, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS loss, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'gain or loss rate is 0' END AS skip_reason FROM customer")
def skipped_simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.operators import simulate

    k = F.col("c_custkey")
    p = views.table(spark, sf_dir, "customer").select(k.alias("sim_id"), F.when(k % 5 == 0, 0.0).otherwise(1.5).alias("gain"), F.when(k % 3 == 0, 0.0).otherwise(0.5).alias("loss"))
    return simulate.with_skip_reason(p)


@query(BR + PACKED + ", t AS (SELECT *, ('0x' || substr(md5('2357/' || group_id || '/' || array_id), 1, 8))::BIGINT % 2 = 1 AS turned FROM packed) SELECT group_id, array_id, turned, array_to_string(CASE WHEN turned THEN list_reverse(tokens) ELSE tokens END, ',') AS tokens FROM t")
def randomly_turned_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second array on average is turned around, by a hash of its name."""
    from stemma.operators import simulate

    p = arrays.packed(views.brand_arrays(spark, sf_dir))
    return simulate.turned(p, "group_id", "array_id").select("group_id", "array_id", "turned", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(BR + PACKED + """, t AS (SELECT group_id, array_id, tokens, len(tokens) // 3 AS a, len(tokens) * 2 // 3 AS b, len(tokens) AS n FROM packed)
SELECT group_id, array_id, array_to_string(tokens[:a] || tokens[a + 1:b] || tokens[a + 1:b] || tokens[b + 1:], ',') AS doubled, array_to_string(tokens[:a] || list_reverse(tokens[a + 1:b]) || tokens[b + 1:], ',') AS turned,
  array_to_string(tokens[a + 1:b] || tokens[:a] || tokens[b + 1:], ',') AS moved, array_to_string(tokens[a + 1:b] || tokens, ',') AS copied FROM t""")
def mutated_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third doubled, turned around, moved to the front, and copied to it."""
    from stemma.operators import simulate

    t = F.col("tokens")
    a, b = F.floor(F.size(t) / 3).cast("int"), F.floor(F.size(t) * 2 / 3).cast("int")
    text = lambda kind, c=None: F.array_join(simulate.mutated(t, kind, a, b, c).cast("array<string>"), ",")
    return arrays.packed(views.brand_arrays(spark, sf_dir)).select("group_id", "array_id", text("duplicate").alias("doubled"), text("reverse").alias("turned"), text("move", F.lit(0)).alias("moved"), text("copy", F.lit(0)).alias("copied"))


@query("WITH s AS (SELECT s_name AS group_id, s_suppkey % 9 + 2 AS n, 3.0 + s_suppkey % 7 AS len, 0.1 + s_suppkey % 5 AS rho, 1.0 + s_suppkey % 3 / 2.0 AS alpha FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS k, count(*) OVER () AS total FROM s) SELECT k + r * total AS sim_id, group_id || '-' || r AS name, CAST(r AS INT) AS run, k + r * total + 7 AS seed, n::INT AS n_leaves, round(rho * len * alpha, 9) AS gain, round(rho, 9)::DOUBLE AS loss, alpha::DOUBLE AS alpha, 'block' AS model FROM k, unnest(range(2)) u(r)")
def imported_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of simulations like a protocol's groups, two runs of each."""
    from stemma.operators import simulate

    k = F.col("s_suppkey")
    protocol = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("group_id"), (k % 9 + 2).alias("n_arrays"), (3.0 + k % 7).alias("mean_length"), F.lit(0.5).alias("rho_idm"), (0.1 + k % 5).alias("rho_bdm"), (1.0 + k % 3 / 2.0).alias("alpha"))
    return simulate.parameters_of(protocol, runs=2, seed=7).withColumn("gain", F.round("gain", 9)).withColumn("loss", F.round("loss", 9))


# --- runs


def _star_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each nation: its suppliers below one root."""
    s = views.table(spark, sf_dir, "supplier")
    leaves = s.select(F.col("s_nationkey").alias("group_id"), F.concat(F.lit("c"), "s_suppkey").alias("node_id"), F.lit("root").alias("parent_id"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("branch_length"))
    return leaves.unionByName(s.select(F.col("s_nationkey").alias("group_id"), F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("branch_length")).distinct())


@query("WITH s AS (SELECT s_nationkey AS group_id, (s_suppkey % 7 + 1)::DOUBLE AS t FROM supplier), l AS (SELECT group_id, count(*) AS n_leaves, list(t ORDER BY t DESC) AS t FROM s GROUP BY ALL) SELECT group_id, n_leaves, CASE WHEN n_leaves = 1 THEN t[1] ELSE (t[1] + t[2]) / 2 END AS height FROM l")
def midpoint_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooted in the middle of its longest path, a tree is half of it high."""
    from stemma.tables import held

    t = held(tree.with_depth(tree.rooted_at_midpoint(_star_trees(spark, sf_dir))))
    return tree.metrics(t).select("group_id", "n_leaves", "height")


@query(BR + ", t AS (SELECT s_nationkey AS group_id, max(s_suppkey % 7 + 1)::DOUBLE AS height FROM supplier GROUP BY ALL), c AS (SELECT c_nationkey AS group_id, count(DISTINCT c_custkey % 11) AS columns FROM customer GROUP BY ALL) SELECT group_id, round(1e-5 / (columns * height), 15) AS gain, round(0.1 / height, 12) AS loss FROM t JOIN c USING (group_id)")
def rescaled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide's rates: loss over the tree's height, gain over columns times height."""
    from stemma import engine

    alignment = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), (F.col("c_custkey") % 11).alias("col"))
    rated = engine.with_rates(_star_trees(spark, sf_dir), alignment, 1e-5, 0.1)
    return rated.where(F.col("parent_id").isNull()).join(alignment.select("group_id").distinct(), "group_id").select("group_id", F.round("gain", 15).alias("gain"), F.round("loss", 12).alias("loss"))


@query(ORDER + ", w AS (SELECT group_id, max(rank) AS width FROM ranks GROUP BY ALL), a AS (SELECT group_id, array_id, width - rank AS col, token FROM arrays JOIN ranks USING (group_id, token) JOIN w USING (group_id)) SELECT group_id, array_id, max(col) OVER (PARTITION BY group_id) - col AS col, token FROM a")
def mirrored_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment read from the other side."""
    from stemma import engine

    e = Events(spark, sf_dir)
    return engine.mirrored(arrays.align_on_order(e.arrays, e.rank))


@query("SELECT s_name AS group_id, printf('%s: %s preferred (statistic %.4f, level %.2f), loss rate %.4f, block length %.4f', s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'BDM' ELSE 'IDM' END, s_suppkey * 0.25, 0.01, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 0.5 ELSE 2.0 END, 1.5) AS line FROM supplier")
def summary_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma import sinks

    k = F.col("s_suppkey")
    p = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("group_id"), F.when(k % 2 == 0, "BDM").otherwise("IDM").alias("model"), (k * 0.25).alias("lrt"), (k * 0.5).alias("rho_bdm"), F.lit(2.0).alias("rho_idm"), F.lit(1.5).alias("alpha"))
    return sinks.summary_lines(p, 0.01)


@query(BR + " SELECT group_id, array_id, pos, CASE WHEN token % 10 = 0 THEN '-' ELSE token::VARCHAR END AS token FROM arrays")
def relabelled_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as numbers by first occurrence, and back; numbers that the map lacks are gaps."""
    b = views.brand_arrays(spark, sf_dir)
    ids = arrays.first_seen_ids(b, "token", "group_id", "array_id", "pos")
    return arrays.names_back(arrays.relabelled(b.withColumn("token", F.col("token").cast("long")), ids), ids.where(F.col("token") % 10 != 0))


@query(BR + PACKED + " SELECT x.group_id, x.array_id, len(list_intersect(x.tokens, y.tokens))::INT AS both, len(list_filter(x.tokens, lambda t: NOT list_contains(y.tokens, t)))::INT AS only_x, len(list_distinct(x.tokens || y.tokens))::INT AS any FROM packed x JOIN packed y ON y.group_id = x.group_id AND y.array_id = (SELECT min(array_id) FROM packed z WHERE z.group_id = x.group_id)")
def token_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each array's tokens against those of its group's first array."""
    p = arrays.packed(views.brand_arrays(spark, sf_dir))
    first = p.groupBy("group_id").agg(F.min_by("tokens", "array_id").alias("y"))
    return p.join(first, "group_id").select("group_id", "array_id", F.size(F.array_intersect("tokens", "y")).alias("both"), F.size(F.array_except("tokens", "y")).alias("only_x"), F.size(F.array_union("tokens", "y")).alias("any"))
