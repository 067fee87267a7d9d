"""Queries over arrays of event tokens: orders, reconstruction, events, fits; each with its SQL twin."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import views
from stemma.functions.scalar import GUIDE_GAIN, GUIDE_LOSS, decision
from stemma.operators import analysis, arrays, fit, reconstruct

GAIN, LOSS = GUIDE_GAIN / 75, GUIDE_LOSS / 3
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EV = "WITH RECURSIVE " + views.EVENT_ARRAYS_SQL
ORDER = (
    EV
    + """,
adjacent AS (SELECT group_id, token AS src, lead(token) OVER (PARTITION BY group_id, array_id ORDER BY pos) AS dst FROM arrays),
edges AS (SELECT DISTINCT * FROM adjacent WHERE dst IS NOT NULL),
closure AS (SELECT group_id, src AS younger, dst AS older FROM edges UNION SELECT c.group_id, c.younger, e.dst FROM closure c JOIN edges e ON c.group_id = e.group_id AND c.older = e.src),
below AS (SELECT group_id, younger AS token, count(*) AS n FROM closure GROUP BY ALL),
ranks AS (SELECT t.group_id, t.token, CAST(row_number() OVER (PARTITION BY t.group_id ORDER BY coalesce(n, 0), t.token) AS INT) AS rank
  FROM (SELECT DISTINCT group_id, token FROM arrays) t LEFT JOIN below USING (group_id, token))"""
)
_A, _B = repr(GAIN), repr(LOSS)
STATES = (
    ORDER
    + ","
    + views.EVENT_TREE_SQL
    + f""",
chain AS (SELECT {_A}::DOUBLE AS a, {_B}::DOUBLE AS b, exp(-({_A}::DOUBLE + {_B}::DOUBLE)) AS e),
p AS (SELECT ln((b + a * e) / (a + b)) AS p00, ln(a * (1 - e) / (a + b)) AS p01, ln(b * (1 - e) / (a + b)) AS p10, ln((a + b * e) / (a + b)) AS p11 FROM chain),
profile AS MATERIALIZED (SELECT g.group_id, 'u' || g.array_id AS node_id, t.token, CAST(x.token IS NOT NULL AS INT) AS present
  FROM (SELECT DISTINCT group_id, array_id FROM arrays) g JOIN (SELECT DISTINCT group_id, token FROM arrays) t USING (group_id) LEFT JOIN arrays x ON x.group_id = g.group_id AND x.array_id = g.array_id AND x.token = t.token),
l3 AS MATERIALIZED (SELECT group_id, node_id, token, present AS c0, present AS c1, CASE present WHEN 1 THEN p01 ELSE p00 END AS m0, CASE present WHEN 1 THEN p11 ELSE p10 END AS m1 FROM profile, p),
s2 AS MATERIALIZED (SELECT group_id, parent_id AS node_id, token, sum(m0) AS l0, sum(m1) AS l1 FROM l3 JOIN tree USING (node_id) GROUP BY ALL),
l2 AS MATERIALIZED (SELECT group_id, node_id, token, CAST(p01 + l1 > p00 + l0 + 1e-9 AS INT) AS c0, CAST(p11 + l1 > p10 + l0 + 1e-9 AS INT) AS c1, greatest(p00 + l0, p01 + l1) AS m0, greatest(p10 + l0, p11 + l1) AS m1 FROM s2, p),
s1 AS MATERIALIZED (SELECT group_id, parent_id AS node_id, token, sum(m0) AS l0, sum(m1) AS l1 FROM l2 JOIN tree USING (node_id) GROUP BY ALL),
l1 AS MATERIALIZED (SELECT group_id, node_id, token, CAST(p01 + l1 > p00 + l0 + 1e-9 AS INT) AS c0, CAST(p11 + l1 > p10 + l0 + 1e-9 AS INT) AS c1, greatest(p00 + l0, p01 + l1) AS m0, greatest(p10 + l0, p11 + l1) AS m1 FROM s1, p),
s0 AS MATERIALIZED (SELECT group_id, parent_id AS node_id, token, sum(m0) AS l0, sum(m1) AS l1 FROM l1 JOIN tree USING (node_id) GROUP BY ALL),
t0 AS MATERIALIZED (SELECT group_id, node_id, token, CAST(l1 + p01 > l0 + p00 + 1e-9 AS INT) AS state FROM s0, p),
t1 AS MATERIALIZED (SELECT l.group_id, l.node_id, l.token, CASE u.state WHEN 0 THEN l.c0 ELSE l.c1 END AS state FROM l1 l JOIN tree USING (node_id) JOIN t0 u ON u.group_id = l.group_id AND u.node_id = tree.parent_id AND u.token = l.token),
t2 AS MATERIALIZED (SELECT l.group_id, l.node_id, l.token, CASE u.state WHEN 0 THEN l.c0 ELSE l.c1 END AS state FROM l2 l JOIN tree USING (node_id) JOIN t1 u ON u.group_id = l.group_id AND u.node_id = tree.parent_id AND u.token = l.token),
states AS MATERIALIZED (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT group_id, node_id, token, present FROM profile),
branch_states AS MATERIALIZED (SELECT s.group_id, s.node_id, s.token, s.state, coalesce(u.state, 0) AS up, tree.parent_id FROM states s JOIN tree USING (node_id) LEFT JOIN states u ON u.group_id = s.group_id AND u.node_id = tree.parent_id AND u.token = s.token),
branch_events AS MATERIALIZED (SELECT group_id, node_id, token, CASE state WHEN 1 THEN 'gain' ELSE 'loss' END AS kind FROM branch_states WHERE state <> up)"""
)
ABOVE = """,
above AS (SELECT node_id, parent_id AS ancestor, branch_length AS distance, 1 AS steps FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.node_id, t.parent_id, a.distance + t.branch_length, a.steps + 1 FROM above a JOIN tree t ON a.ancestor = t.node_id WHERE t.parent_id IS NOT NULL)"""
BLOCKS = """,
ordered AS (SELECT b.*, r.rank, sum(state) OVER (PARTITION BY b.group_id, b.node_id ORDER BY r.rank) AS block FROM branch_states b JOIN ranks r USING (group_id, token) WHERE up = 1 AND b.parent_id IS NOT NULL),
blocks AS (SELECT group_id, node_id, CAST(block AS BIGINT) AS block, count(*) AS size FROM ordered WHERE state = 0 GROUP BY ALL),
stats AS (SELECT s.group_id, s.node_id, t.branch_length AS t, coalesce(b.m, 0)::BIGINT AS m, coalesce(b.lost, 0)::BIGINT AS lost, coalesce(k.kept, 0)::BIGINT AS kept
  FROM (SELECT DISTINCT group_id, node_id FROM states) s JOIN tree t ON t.node_id = s.node_id AND t.parent_id IS NOT NULL
  LEFT JOIN (SELECT group_id, node_id, count(*) AS m, sum(size) AS lost FROM blocks GROUP BY ALL) b ON b.group_id = s.group_id AND b.node_id = s.node_id
  LEFT JOIN (SELECT group_id, node_id, count(*) AS kept FROM ordered WHERE state = 1 GROUP BY ALL) k ON k.group_id = s.group_id AND k.node_id = s.node_id)"""


class Events:
    """The tables that most queries here start from, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.arrays = arrays._held(views.event_arrays(spark, sf_dir))
        self.tree = arrays._held(views.event_tree(self.arrays))

    @cached_property
    def order(self) -> DataFrame:
        return arrays.closure(arrays.edges(self.arrays))

    @cached_property
    def rank(self) -> DataFrame:
        return arrays._held(arrays.topological_rank(self.arrays, self.order))

    @cached_property
    def profile(self) -> DataFrame:
        return arrays.presence(self.arrays, self.arrays).select("group_id", F.concat(F.lit("u"), "array_id").alias("node_id"), "token", "present")

    @cached_property
    def with_parents(self) -> DataFrame:
        """The states, each with its parent's."""
        return arrays._held(reconstruct.joint_states(self.profile, self.tree, GAIN, LOSS, parents=True))

    @property
    def states(self) -> DataFrame:
        return self.with_parents.drop("up")

    @property
    def events(self) -> DataFrame:
        return reconstruct.branch_events(self.with_parents, self.tree)

    def statistics(self) -> DataFrame:
        states = self.with_parents
        return fit.branch_statistics(states, reconstruct.loss_blocks(states, self.tree, self.rank), self.tree)


@query(EV + " SELECT * FROM arrays")
def event_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_arrays(spark, sf_dir)


@query(ORDER + " SELECT * FROM edges")
def psio_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.edges(views.event_arrays(spark, sf_dir))


@query(ORDER + " SELECT * FROM closure")
def psio_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Events(spark, sf_dir).order


@query(ORDER + " SELECT * FROM ranks")
def topological_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Events(spark, sf_dir).rank


@query(ORDER + ", w AS (SELECT group_id, max(rank) AS width FROM ranks GROUP BY ALL) SELECT group_id, array_id, width - rank AS col, token FROM arrays JOIN ranks USING (group_id, token) JOIN w USING (group_id)")
def alignment_on_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return arrays.align_on_order(e.arrays, e.rank)


@query(ORDER + " SELECT group_id, array_id, pos, token, rank AS number FROM arrays JOIN ranks USING (group_id, token)")
def numbered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return arrays.numbered(e.arrays, e.rank)


@query(STATES + " SELECT group_id, node_id, token, state FROM states")
def ml_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Events(spark, sf_dir).states


@query(STATES + " SELECT * FROM branch_events")
def branch_gains_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return e.events


@query(STATES + " SELECT group_id, depth, count(*) FILTER (kind = 'gain') AS gains, count(*) FILTER (kind = 'loss') AS losses FROM branch_events JOIN tree USING (node_id) GROUP BY ALL")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    events = e.events.join(e.tree.select("node_id", "depth"), "node_id")
    return events.groupBy("group_id", "depth").agg(F.count_if(F.col("kind") == "gain").alias("gains"), F.count_if(F.col("kind") == "loss").alias("losses"))


@query(
    STATES
    + ABOVE
    + """
SELECT DISTINCT g.group_id, g.node_id, g.token FROM branch_events g JOIN above a ON a.node_id = g.node_id
JOIN branch_events h ON h.group_id = g.group_id AND h.node_id = a.ancestor AND h.kind = 'gain'
JOIN closure c ON c.group_id = g.group_id AND c.younger = h.token AND c.older = g.token WHERE g.kind = 'gain'"""
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return reconstruct.contradictions(e.events, e.tree, e.order)


@query(STATES + BLOCKS + " SELECT * FROM blocks")
def loss_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return reconstruct.loss_blocks(e.with_parents, e.tree, e.rank)


POSITIONS = """,
places AS (SELECT s.group_id, s.node_id AS parent_id, s.token, count(*) OVER (PARTITION BY s.group_id, s.node_id) AS n, row_number() OVER (PARTITION BY s.group_id, s.node_id ORDER BY r.rank DESC) - 1 AS k FROM states s JOIN ranks r USING (group_id, token) WHERE state = 1),
positions AS (SELECT b.group_id, b.node_id, b.token, CASE WHEN n = 1 THEN 1.0 ELSE k / (n - 1) END AS position FROM branch_states b JOIN places p ON p.group_id = b.group_id AND p.parent_id = b.parent_id AND p.token = b.token WHERE b.state = 0 AND b.up = 1)"""


@query(STATES + POSITIONS + " SELECT group_id, node_id, token, round(position, 9) AS position FROM positions")
def relative_loss_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return reconstruct.loss_positions(e.states, e.tree, e.rank).withColumn("position", F.round("position", 9))


def _offsets_sql(order: str, kept: bool) -> str:
    k = f"row_number() OVER (PARTITION BY b.group_id, b.node_id ORDER BY r.rank {order}) - 1"
    return (
        STATES
        + f""",
o AS (SELECT b.group_id, b.node_id, b.state, {k} AS k FROM branch_states b JOIN ranks r USING (group_id, token) WHERE up = 1 AND b.parent_id IS NOT NULL),
anchored AS (SELECT *, {"k - min(CASE WHEN state = 1 THEN k END) OVER (PARTITION BY group_id, node_id)" if kept else "k"} AS m FROM o)
SELECT group_id, CAST(m AS INT) AS m, sum(state)::BIGINT AS present, count(*) AS total FROM anchored WHERE m IS NOT NULL GROUP BY ALL"""
    )


def _offsets(spark: SparkSession, sf_dir: str, anchor: str) -> DataFrame:
    e = Events(spark, sf_dir)
    return reconstruct.offsets(e.states, e.tree, e.rank, anchor).withColumn("m", F.col("m").cast("int"))


@query(_offsets_sql("DESC", False))
def presence_offsets_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "first")


@query(_offsets_sql("ASC", False))
def presence_offsets_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "last")


@query(_offsets_sql("DESC", True))
def presence_offsets_first_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "first_kept")


@query(_offsets_sql("ASC", True))
def presence_offsets_last_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "last_kept")


@query(STATES + BLOCKS + " SELECT * FROM stats")
def branch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Events(spark, sf_dir).statistics()


LNL = "(CASE WHEN m > 0 THEN m * ln((1 - exp(-rho * t)) / alpha) ELSE 0 END + CASE WHEN lost > m THEN (lost - m) * ln(1 - exp(-rho * t) / alpha) ELSE 0 END - rho * t * kept)"
GRID = [(r, a) for r in (0.05, 0.1, 0.2, 0.4, 0.8) for a in (1.25, 1.5, 2.0, 3.0)]


@query(STATES + BLOCKS + f", grid AS (SELECT * FROM (VALUES {', '.join(f'({r}::DOUBLE, {a}::DOUBLE)' for r, a in GRID)}) v(rho, alpha)) SELECT group_id, rho, alpha, round(sum({LNL}), 6) AS lnl FROM stats, grid GROUP BY ALL")
def tree_loglik_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame(GRID, "rho double, alpha double")
    return fit.likelihood_grid(Events(spark, sf_dir).statistics(), grid).withColumn("lnl", F.round("lnl", 6))


def _estimates_sql(pooled: str, key: str) -> str:
    return (
        STATES
        + BLOCKS
        + f""",
pooled AS ({pooled}),
e1 AS (SELECT *, CASE WHEN kept > 0 AND lost > 0 THEN -ln(kept / (lost + kept)) WHEN lost = 0 THEN 0.0 END AS rho_idm, (kept - m) / kept AS u FROM pooled),
e2 AS (SELECT *, m / (lost * u) AS q FROM e1),
e3 AS (SELECT *, CASE WHEN kept > m AND m > 0 AND q <= 1 THEN -ln(u) ELSE rho_idm END AS rho_bdm, CASE WHEN kept > m AND m > 0 AND q <= 1 THEN 1 / q ELSE 1.0 END AS alpha FROM e2),
e4 AS (SELECT *, CASE WHEN lost > 0 THEN lost * ln(1 - exp(-rho_idm)) ELSE 0 END - rho_idm * kept AS lnl_idm,
  CASE WHEN m > 0 THEN m * ln((1 - exp(-rho_bdm)) / alpha) ELSE 0 END + CASE WHEN lost > m THEN (lost - m) * ln(1 - exp(-rho_bdm) / alpha) ELSE 0 END - rho_bdm * kept AS b FROM e3),
e5 AS (SELECT *, greatest(b, lnl_idm) AS lnl_bdm, 2 * (greatest(b, lnl_idm) - lnl_idm) AS lrt FROM e4)
SELECT {key}, m, lost, kept, round(rho_idm, 6) AS rho_idm, round(rho_bdm, 6) AS rho_bdm, round(alpha, 6) AS alpha, round(lnl_idm, 4) AS lnl_idm, round(lnl_bdm, 4) AS lnl_bdm, round(lrt, 4) AS lrt,
  CASE WHEN lrt > 3.841458820694124 THEN 'BDM' ELSE 'IDM' END AS model,
  CASE WHEN m > 0 THEN round(greatest(1.0, 2 / (m + 1 - sqrt(greatest(0.0, pow(m + 1, 2) - 4 * m / alpha)))), 6) END AS alpha_unbiased FROM e5"""
    )


SUMS = "sum(m)::BIGINT AS m, sum(lost)::BIGINT AS lost, sum(kept)::BIGINT AS kept"


def _rounded(estimates: DataFrame, key: str) -> DataFrame:
    return estimates.select(key, "m", "lost", "kept", *(F.round(c, 6).alias(c) for c in ("rho_idm", "rho_bdm", "alpha")), *(F.round(c, 4).alias(c) for c in ("lnl_idm", "lnl_bdm", "lrt")), "model", F.round("alpha_unbiased", 6).alias("alpha_unbiased"))


@query(_estimates_sql(f"SELECT group_id, {SUMS} FROM stats GROUP BY ALL", "group_id"))
def mle_idm_bdm_lrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit.estimates(fit.pooled_statistics(Events(spark, sf_dir).statistics(), "group_id")), "group_id")


@query(_estimates_sql(f"SELECT group_id, {SUMS} FROM stats GROUP BY ROLLUP (group_id)", "group_id"))
def pooled_estimates_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fit.estimates(fit.with_total(Events(spark, sf_dir).statistics(), "group_id")), "group_id")


@query(_estimates_sql(f"SELECT pool, {SUMS} FROM stats JOIN (SELECT group_id, least((row_number() OVER (ORDER BY group_id) - 1) // 2, greatest(1, count(*) OVER () // 2) - 1) AS pool FROM (SELECT DISTINCT group_id FROM stats)) USING (group_id) GROUP BY ALL", "pool"))
def pooled_estimates_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = arrays._held(Events(spark, sf_dir).statistics())
    pools = fit.chunked(stats.select("group_id").distinct(), 2)
    return _rounded(fit.estimates(fit.pooled_statistics(stats.join(pools, "group_id"), "pool")), "pool")


BOUNDS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(
    STATES
    + POSITIONS
    + """,
parents AS (SELECT b.group_id, b.node_id, count(*) AS n FROM branch_states b WHERE up = 1 AND parent_id IS NOT NULL GROUP BY ALL),
every AS (SELECT CASE WHEN n = 1 THEN 1.0 ELSE k / (n - 1) END AS position FROM parents, unnest(range(n)) u(k)),
d AS (SELECT position, 1 AS lost, 0 AS place FROM positions UNION ALL SELECT position, 0, 1 FROM every),
b AS (SELECT CASE WHEN position <= 0 THEN 0 WHEN position <= 0.25 THEN 1 WHEN position <= 0.5 THEN 2 WHEN position <= 0.75 THEN 3 WHEN position < 1 THEN 4 ELSE 5 END AS bin, sum(lost)::BIGINT AS lost, sum(place)::BIGINT AS places FROM d GROUP BY ALL)
SELECT bin, lost, places, round(lost / places, 9) AS frequency FROM b"""
)
def binned_loss_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Events(spark, sf_dir)
    states, rank = e.states, e.rank
    losses = reconstruct.loss_positions(states, e.tree, rank)
    n = states.where(F.col("state") == 1).groupBy("group_id", F.col("node_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("n")).join(e.tree.select("node_id", "parent_id"), "parent_id")
    return analysis.binned_loss_frequency(losses, n, BOUNDS).withColumn("frequency", F.round("frequency", 9))


@query(
    STATES
    + BLOCKS
    + """,
s AS (SELECT group_id, sum(m)::DOUBLE AS m, sum(lost)::DOUBLE AS lost FROM stats GROUP BY ALL), d AS (SELECT group_id, (m - 0.9 * lost) / 10 AS difference FROM s)
SELECT group_id, round(difference, 6) AS difference, CASE WHEN difference < -5 THEN 'reverse' WHEN difference > 5 THEN 'forward' ELSE 'nd' END AS recommendation FROM d"""
)
def decision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision with a made-up difference, to see all its branches."""
    s = fit.pooled_statistics(Events(spark, sf_dir).statistics(), "group_id").withColumn("difference", (F.col("m") - 0.9 * F.col("lost")) / 10)
    return s.select("group_id", F.round("difference", 6).alias("difference"), decision(F.col("difference")).alias("recommendation"))
