"""Queries over alignments, simulations, refined reconstructions, fits and drawing data; with SQL twins where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import sinks, views
from stemma.functions import scalar as fn
from stemma.operators import align, filters, fit, reconstruct, simulate, tree, visual
from stemma.tables import held as _held

from .event_queries import ABOVE, BLOCKS, GAIN, LOSS, STATES, Events
from .table_queries import BR, DISTANCES, RAW, _raw, upgma_trees

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulation for each nation: rates follow its customers and suppliers."""
    c, s = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "supplier")
    n = c.groupBy(F.col("c_nationkey").alias("sim_id")).agg(F.count(F.lit(1)).alias("customers")).join(s.groupBy(F.col("s_nationkey").alias("sim_id")).agg(F.count(F.lit(1)).alias("suppliers")), "sim_id", "left")
    return n.select(F.col("sim_id").cast("long").alias("sim_id"), F.lit(12).alias("n_leaves"), (6.0 + F.col("customers") % 3).alias("gain"), (0.3 + F.coalesce("suppliers", F.lit(0)) % 4 / 10).alias("loss"), (1.0 + F.col("customers") % 4 / 2).alias("alpha"), F.element_at(F.array(F.lit("block"), F.lit("independent"), F.lit("fragment")), (F.col("sim_id") % 3 + 1).cast("int")).alias("model"))


@query()
def simulated_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate(_parameters(spark, sf_dir)).select("sim_id", "node_id", "parent_id", F.round("branch_length", 9).alias("branch_length"), "is_leaf", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query()
def simulated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return simulate.simulated_events(_parameters(spark, sf_dir)).select("sim_id", "node_id", "kind", F.round("time", 9).alias("time"), text("tokens"), "before", text("places"))


@query()
def simulation_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each simulation with what is true of it."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 6).cast("string")), ",").alias(c)
    p = simulate.run(_parameters(spark, sf_dir), turn=True)["protocol"]
    return p.select("sim_id", "model", "n_tokens", F.round("mean_length", 6).alias("mean_length"), "n_never_seen", "orientation", text("event_loss_positions"), text("branch_loss_positions"))


@query()
def simulated_trees_newick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.newick(simulate.simulate(_parameters(spark, sf_dir)).withColumnRenamed("sim_id", "group_id"))


@query()
def simulated_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_groups(simulate.as_groups(simulate.simulate(_parameters(spark, sf_dir))))


@query()
def simulated_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models fitted to the true losses of each simulation; every loss is a block."""
    nodes, events = simulate.simulate(_parameters(spark, sf_dir)), simulate.simulated_events(_parameters(spark, sf_dir))
    lost = events.where(F.col("kind") == "loss").groupBy("sim_id", "node_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("tokens")).alias("lost"))
    parents = nodes.select("sim_id", F.col("node_id").alias("parent_id"), F.col("tokens").alias("up"))
    branches = nodes.join(parents, ["sim_id", "parent_id"]).join(lost, ["sim_id", "node_id"], "left")
    zero = F.lit(0).cast("long")
    rows = branches.select("sim_id", F.col("branch_length").alias("t"), F.coalesce("m", zero).alias("m"), F.coalesce("lost", zero).alias("lost"), F.size(F.array_intersect("up", "tokens")).cast("long").alias("kept"))
    return fit.fit(rows, "sim_id")


def _orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each nation and segment, an array for each customer: its orders' months by date, copies included."""
    from pyspark.sql import Window

    o, c = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.concat_ws("_", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("group_id"), F.col("c_custkey").alias("array_id"), "o_orderdate", "o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("token"))
    return rows.select("group_id", "array_id", (F.row_number().over(Window.partitionBy("group_id", "array_id").orderBy("o_orderdate", "o_orderkey")) - 1).alias("pos"), "token")


@query()
def aligned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_groups(_orders_by_customer(spark, sf_dir))


@query()
def joined_duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.join_duplicates(align.align_groups(_orders_by_customer(spark, sf_dir)))


@query()
def renamed_duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.renamed_duplicates(align.align_groups(_orders_by_customer(spark, sf_dir)))


#: What comes last in a column depends on the column before only by its last token, which never comes last again but
#: where it is alone: the best two tokens of each column are enough.
SPLIT = f"""WITH RECURSIVE {RAW},
cols AS (SELECT group_id, pos, token, dense_rank() OVER (PARTITION BY group_id ORDER BY pos) AS k FROM (SELECT DISTINCT group_id, pos, token FROM raw)),
marked AS (SELECT c.*, n.token IS NOT NULL AS after FROM cols c LEFT JOIN cols n ON n.group_id = c.group_id AND n.k = c.k + 1 AND n.token = c.token),
top AS (SELECT group_id, k, list(token ORDER BY after DESC, token::VARCHAR DESC) AS t FROM marked GROUP BY ALL),
last AS (SELECT group_id, k, t[1] AS token FROM top WHERE k = 1 UNION ALL
  SELECT p.group_id, p.k, CASE WHEN p.t[1] = l.token AND len(p.t) > 1 THEN p.t[2] ELSE p.t[1] END FROM last l JOIN top p ON p.group_id = l.group_id AND p.k = l.k + 1),
kinds AS (SELECT m.*, CASE WHEN l.token IS NOT NULL AND after THEN 1 WHEN l.token IS NOT NULL THEN 0 WHEN after THEN 3 ELSE 2 END AS kind FROM marked m LEFT JOIN last l ON l.group_id = m.group_id AND l.k = m.k - 1 AND l.token = m.token),
placed AS (SELECT group_id, pos, token, CAST(row_number() OVER (PARTITION BY group_id ORDER BY pos, kind, token::VARCHAR) - 1 AS INT) AS col FROM kinds)
SELECT group_id, array_id, col, token FROM raw JOIN placed USING (group_id, pos, token)"""


@query(SPLIT)
def split_mismatch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.split_columns(_raw(spark, sf_dir).select("group_id", "array_id", F.col("pos").alias("col"), "token"))


CUSTOMERS = """WITH named AS (SELECT c_nationkey || '_' || c_mktsegment AS group_id, c_custkey AS array_id, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT group_id, count(*) AS cells, count(DISTINCT array_id) AS arrays, count(DISTINCT array_id) AS in_order, 0::BIGINT AS mixed_columns FROM named GROUP BY ALL"""


def _kept_in_order(alignment: DataFrame, given: DataFrame, token: str = "token") -> DataFrame:
    """group_id, cells, arrays, arrays whose tokens stand in the order given, columns of several tokens."""
    text = lambda rows, at, t: rows.groupBy("group_id", "array_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(at, F.col(t).cast("string").alias("t")))), lambda x: x["t"])).alias(at))
    both = text(alignment, "col", token).join(text(given, "pos", "token"), ["group_id", "array_id"])
    mixed = alignment.groupBy("group_id", "col").agg(F.countDistinct(token).alias("n")).groupBy("group_id").agg(F.count_if(F.col("n") > 1).alias("mixed_columns"))
    cells = alignment.groupBy("group_id").agg(F.count(F.lit(1)).alias("cells"))
    return both.groupBy("group_id").agg(F.count(F.lit(1)).alias("arrays"), F.count_if(F.col("col") == F.col("pos")).alias("in_order")).join(cells, "group_id").join(mixed, "group_id")


@query(CUSTOMERS)
def alignment_keeps_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every alignment must do: keep each array's tokens in their order, one token to a column."""
    given = _orders_by_customer(spark, sf_dir)
    return _kept_in_order(align.align_groups(given), given)


@query(CUSTOMERS)
def renamed_columns_keep_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with joined and renamed columns; every name stands in one column."""
    given = _orders_by_customer(spark, sf_dir)
    out = _held(align.renamed_duplicates(align.join_duplicates(align.align_groups(given))))
    several = out.groupBy("group_id", "token").agg(F.countDistinct("col").alias("n")).groupBy("group_id").agg(F.count_if(F.col("n") > 1).alias("spread"))
    return _kept_in_order(out, given, "base").join(several, "group_id").withColumn("mixed_columns", F.col("mixed_columns") + F.col("spread")).drop("spread")


@query(STATES + """
SELECT group_id, count(*) AS cells, count(*) AS as_observed, 0::BIGINT AS contradictions FROM profile GROUP BY ALL""")
def refinement_keeps_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every refined reconstruction must do: leave the leaves as they are, and no contradiction."""
    e = Events(spark, sf_dir)
    order, above = e.order, tree.ancestors(e.tree)
    states = reconstruct.refined_states(e.profile, e.tree, order, GAIN, LOSS, above=above)[0]
    left = reconstruct.contradictions(reconstruct.branch_events(states, e.tree), e.tree, order, above).groupBy("group_id").agg(F.count(F.lit(1)).alias("contradictions"))
    leaves = e.profile.join(states, ["group_id", "node_id", "token"]).groupBy("group_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("present") == F.col("state")).alias("as_observed"))
    return leaves.join(left, "group_id", "left").select("group_id", "cells", "as_observed", F.coalesce("contradictions", F.lit(0)).alias("contradictions"))


@query(DISTANCES + f", d AS (SELECT group_id, least({fn.MAX_BRANCH}::DOUBLE, greatest({fn.MIN_BRANCH}::DOUBLE, CASE WHEN bool_and(none) THEN 0 ELSE sum(t) END)) AS distance FROM sides JOIN times USING (g, k, n, s) GROUP BY group_id, greatest(x, y), least(x, y)) SELECT i.group_id, i.n AS leaves, 2 * i.n - 1 AS nodes, true AS ultrametric, round(min(distance) / 2, 7) AS lowest FROM d JOIN (SELECT group_id, count(*) AS n FROM ids GROUP BY ALL) i USING (group_id) GROUP BY ALL")
def average_linkage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every group's tree: its leaves and nodes, that leaves are level, and the height of the first join."""
    nodes = _held(upgma_trees(spark, sf_dir))
    t = _held(tree.with_depth(nodes))
    inner = t.select("group_id", F.col("parent_id").alias("node_id")).distinct()
    lowest = t.join(inner, ["group_id", "node_id"], "left_anti").groupBy("group_id").agg(F.min("branch_length").alias("lowest"))
    facts = tree.metrics(t, 6).select("group_id", F.col("n_leaves").alias("leaves"), "ultrametric").join(t.groupBy("group_id").agg(F.count(F.lit(1)).alias("nodes")), "group_id")
    return facts.join(lowest, "group_id").select("group_id", "leaves", "nodes", "ultrametric", F.round("lowest", 7).alias("lowest"))


@query()
def refined_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return reconstruct.refined_states(e.profile, e.tree, e.order, GAIN, LOSS)[0]


@query(STATES + ABOVE + """,
first AS (SELECT b.*, row_number() OVER (PARTITION BY b.group_id, b.token ORDER BY t.depth, b.node_id) AS k FROM branch_events b JOIN tree t USING (node_id) WHERE kind = 'gain')
SELECT g.group_id, count(f.token) AS n FROM (SELECT DISTINCT group_id FROM first) g LEFT JOIN first f ON f.group_id = g.group_id AND f.k > 1 GROUP BY ALL""")
def moved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    gains = e.events.where(F.col("kind") == "gain").join(e.tree.select("node_id", "depth"), "node_id")
    return reconstruct.moved_tokens(gains, gains.limit(0))


@query(STATES + ABOVE + """,
first AS (SELECT b.*, row_number() OVER (PARTITION BY b.group_id, b.token ORDER BY t.depth, b.node_id) AS k FROM branch_events b JOIN tree t USING (node_id) WHERE kind = 'gain'),
moved AS (SELECT * FROM first WHERE k > 1 AND NOT (token % 3 = 0 AND node_id LIKE 'u%'))
SELECT g.group_id, count(m.token) AS n FROM (SELECT DISTINCT group_id FROM first) g LEFT JOIN moved m USING (group_id) GROUP BY ALL""")
def tokens_moved_from_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains again elsewhere, but for those that a guide already has."""
    e = Events(spark, sf_dir)
    gains = e.events.where(F.col("kind") == "gain").join(e.tree.select("node_id", "depth"), "node_id")
    return reconstruct.moved_tokens(gains, gains.where((F.col("token") % 3 == 0) & F.startswith("node_id", F.lit("u"))))


@query(STATES + " SELECT group_id, token, bool_or(node_id LIKE 'u%') AS on_leaf FROM branch_events WHERE kind = 'gain' GROUP BY ALL")
def leaf_only_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return reconstruct.leaf_only_gains(e.events, e.tree)


@query(STATES + ABOVE + """,
had AS (SELECT DISTINCT s.group_id, a.node_id, s.token FROM states s JOIN above a ON a.ancestor = s.node_id WHERE s.state = 1 AND a.node_id LIKE 'u%')
SELECT s.group_id, s.node_id, s.token, CASE WHEN s.state = 1 THEN s.token::VARCHAR WHEN h.token IS NOT NULL THEN 'X' ELSE '-' END AS glyph
FROM states s LEFT JOIN had h USING (group_id, node_id, token) WHERE s.node_id LIKE 'u%'""")
def leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return visual.leaf_rows(e.states, e.tree, tree.leaves(e.tree))


@query(STATES + """,
l AS (SELECT group_id, node_id, kind, list(token::VARCHAR ORDER BY rank) AS t FROM branch_events JOIN ranks USING (group_id, token) GROUP BY ALL)
SELECT group_id, node_id, kind, CASE WHEN len(t) > 3 THEN t[1] || ' - ' || t[-1] ELSE array_to_string(t, ' ') END AS label FROM l""")
def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return visual.event_labels(e.events, e.rank)


def _bundled(rows: str) -> str:
    """A JSON object of lists of tokens by node; rows: group_id, node_id, token."""
    lists = f"SELECT group_id, node_id, string_agg(token::VARCHAR, ',' ORDER BY token) AS tokens FROM {rows} GROUP BY ALL"
    return f"SELECT group_id, '{{' || string_agg('\"' || node_id || '\":[' || tokens || ']', ',' ORDER BY node_id) || '}}' AS json FROM ({lists}) GROUP BY ALL"


@query(STATES + f""",
j1 AS ({_bundled("states WHERE state = 1")}), j2 AS ({_bundled("branch_events WHERE kind = 'gain'")}), j3 AS ({_bundled("branch_events WHERE kind = 'loss'")}),
j0 AS (SELECT group_id, '[' || string_agg(token::VARCHAR, ',' ORDER BY rank) || ']' AS json FROM ranks GROUP BY ALL)
SELECT j0.group_id, j0.json AS "order", j1.json AS profiles, j2.json AS gains, j3.json AS losses FROM j0 LEFT JOIN j1 USING (group_id) LEFT JOIN j2 USING (group_id) LEFT JOIN j3 USING (group_id)""")
def event_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return sinks.event_bundle(e.states, e.events, e.rank).withColumn("order", F.to_json("order"))


@query(STATES + """,
d3 AS (SELECT node_id, 0.0::DOUBLE AS unseen FROM tree WHERE depth = 3),
d2 AS (SELECT t.parent_id AS node_id, product(1 - exp(-0.3::DOUBLE) * (1 - unseen)) AS unseen FROM d3 JOIN tree t USING (node_id) GROUP BY ALL),
d1 AS (SELECT t.parent_id AS node_id, product(1 - exp(-0.3::DOUBLE) * (1 - unseen)) AS unseen FROM d2 JOIN tree t USING (node_id) GROUP BY ALL),
d0 AS (SELECT t.parent_id AS node_id, product(1 - exp(-0.3::DOUBLE) * (1 - unseen)) AS unseen FROM d1 JOIN tree t USING (node_id) GROUP BY ALL),
u AS (SELECT * FROM d3 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d0)
SELECT group_id, node_id, count(*) AS gains, round(any_value(unseen), 9) AS unseen FROM branch_events JOIN u USING (node_id) WHERE kind = 'gain' GROUP BY ALL""")
def unseen_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    gains = e.events.where(F.col("kind") == "gain").groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("gains"))
    return fit.unseen_probability(e.tree, gains, 0.3).select("group_id", "node_id", "gains", F.round("unseen", 9).alias("unseen"))


@query("WITH s AS (SELECT s_suppkey AS k, 1 + s_suppkey % 9 AS n, 0.5 + s_suppkey % 7 AS r FROM supplier) SELECT k, round((n + 1) * (n + 2) / (2 * r) / (SELECT product((i + 1) * (i + 2) / (2 * r) + 1) FROM unnest(range(0, n + 1)) u(i)), 9) AS p FROM s")
def fragment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return views.table(spark, sf_dir, "supplier").select(k.alias("k"), F.round(fn.fragment_pmf(1 + k % 9, 0.5 + k % 7), 9).alias("p"))


@query(BR + " SELECT group_id, array_id, '>' || array_id || chr(10) || string_agg(token::VARCHAR, ', ' ORDER BY pos) AS record FROM arrays GROUP BY group_id, array_id")
def array_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.array_lines(views.brand_arrays(spark, sf_dir))


@query("SELECT c_nationkey AS group_id, '{' || string_agg('\"' || c_custkey || '\":\"' || c_mktsegment || '\"', ',' ORDER BY c_custkey::VARCHAR) || '}' AS json FROM customer GROUP BY ALL")
def json_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "group_id")
    return sinks.as_json_map(c, "c_custkey", "c_mktsegment", "group_id")


@query(STATES + BLOCKS + """,
old AS (SELECT DISTINCT group_id, token FROM branch_events WHERE kind = 'gain' AND node_id = 'root'),
tokens AS (SELECT group_id, node_id, CAST(block AS BIGINT) AS block, token FROM ordered WHERE state = 0)
SELECT t.group_id, t.node_id, t.block, count(*) AS size, count(o.token) AS old_tokens FROM tokens t LEFT JOIN old o USING (group_id, token) GROUP BY ALL HAVING count(o.token) > 0""")
def blocks_with_old_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    old = filters.old_tokens(e.events, e.tree)
    blocks = filters.blocks_with(reconstruct.loss_block_tokens(e.with_parents, e.tree, e.rank), old)
    marked = blocks.join(old.withColumn("old", F.lit(1)), ["group_id", "token"], "left")
    return marked.groupBy("group_id", "node_id", "block").agg(F.count(F.lit(1)).alias("size"), F.count("old").alias("old_tokens"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem SEMI JOIN (SELECT l_partkey FROM lineitem GROUP BY ALL HAVING count(*) >= 30) USING (l_partkey)")
def common_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.common_categories(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_partkey", 30)


@query("SELECT n_name, least(abs(n_nationkey * 10 - s), abs(n_nationkey * 10 - s - 40), abs(n_nationkey * 10 + 25 - s), abs(n_nationkey * 10 + 25 - s - 40)) AS distance FROM (SELECT n_name, n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT * 70 AS s FROM nation)")
def gene_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    rows = n.select("n_name", (k * 10).alias("array_start"), (k * 10 + 25).alias("array_end"), F.array(F.struct((F.col("n_regionkey").cast("long") * 70).alias("start"), F.lit(40).cast("long").alias("length"))).alias("genes"))
    return filters.with_gene_distance(rows).select("n_name", "distance")


@query()
def simulated_precise_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The death process fitted to the lost runs of each simulation's branches."""
    nodes = simulate.simulate(_parameters(spark, sf_dir))
    parents = nodes.select("sim_id", F.col("node_id").alias("parent_id"), F.col("tokens").alias("up"))
    both = nodes.join(parents, ["sim_id", "parent_id"])
    runs = F.filter(F.split(F.array_join(F.transform("up", lambda t: F.when(F.array_contains("tokens", t), ",").otherwise("x")), ""), ","), lambda s: s != "")
    rows = both.select("sim_id", F.col("branch_length").alias("t"), F.size(F.array_intersect("up", "tokens")).cast("long").alias("kept"), F.transform(runs, lambda s: F.length(s)).alias("sizes"))
    return fit.fit_precise(rows, "sim_id").select("sim_id", F.round("rho", 4).alias("rho"), F.round("alpha", 4).alias("alpha"), F.round("lnl", 4).alias("lnl"))
