"""Simulated trees and arrays with known events; each simulation is a row of a parameter table and runs in one task.

Arrays begin with the youngest token. Tokens are numbered in the order in which they arise, per simulation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.scalar import estimated_gain
from stemma.tables import held, numbered_rows


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """sim_id and a row for each combination; seeds follow sim_id."""
    return grid_of(*(spark.createDataFrame([(x,) for x in v], [name]).coalesce(1) for name, v in values.items()))


def grid_of(*values: DataFrame) -> DataFrame:
    """sim_id and a row for each combination of the tables' rows, numbered in order; a grid is a table of parameters."""
    out = values[0]
    for v in values[1:]:
        out = out.join(v)
    return numbered_rows(out, "sim_id", *out.columns).select("sim_id", *out.columns)


def with_skip_reason(parameters: DataFrame) -> DataFrame:
    """parameters with the reason why a row isn't simulated, null if it is."""
    return parameters.withColumn("skip_reason", F.when((F.col("gain") == 0) | (F.col("loss") == 0), "gain or loss rate is 0"))


def parameters_of(protocol: DataFrame, model: str = "block", runs: int = 1, seed: int = 0) -> DataFrame:
    """Parameters of simulations that are like a protocol's groups, `runs` of each; the mean length is kept.

    protocol: group_id, n_arrays, mean_length, rho_idm, rho_bdm, alpha. Seeds follow sim_id.
    """
    block = model == "block"
    loss, alpha = (F.col("rho_bdm"), F.col("alpha")) if block else (F.col("rho_idm"), F.lit(1.0))
    named = protocol.select("group_id", F.col("n_arrays").cast("int").alias("n_leaves"), estimated_gain(F.lit(model), loss, F.col("mean_length"), alpha).alias("gain"), loss.alias("loss"), alpha.alias("alpha"), F.lit(model).alias("model"))
    n = named.count()
    out = repeated(numbered_rows(named, "k", "group_id"), runs)
    return out.select((F.col("k") + F.col("run") * n).alias("sim_id"), F.concat_ws("-", "group_id", F.col("run").cast("string")).alias("name"), "run", (F.col("k") + F.col("run") * n + seed).alias("seed"), "n_leaves", "gain", "loss", "alpha", "model")


def as_states(simulated: DataFrame) -> DataFrame:
    """The true arrays as a reconstruction: group_id, node_id, token, state for all nodes and tokens of a simulation."""
    s = simulated.select(F.col("sim_id").alias("group_id"), "node_id", "tokens")
    every = s.select("group_id", F.explode("tokens").alias("token")).distinct()
    return s.join(every, "group_id").select("group_id", "node_id", "token", F.array_contains("tokens", F.col("token")).cast("int").alias("state"))


def loss_positions(simulated: DataFrame, events: DataFrame) -> DataFrame:
    """sim_id, by, position: places of lost tokens in their arrays, 0 the youngest and 1 the oldest.

    by event: in the array before each event; by branch: in the parent's array, once for each branch.
    """
    at = lambda k, n: F.when(n == 1, 1.0).otherwise(k / (n - 1))
    lost = events.where(F.col("kind") == "loss").select("sim_id", "before", F.explode("places").alias("k"))
    parents = simulated.select("sim_id", F.col("node_id").alias("parent_id"), F.col("tokens").alias("up"))
    both = simulated.join(parents, ["sim_id", "parent_id"]).select("sim_id", "tokens", F.size("up").alias("n"), F.posexplode("up").alias("k", "token"))
    gone = both.where(~F.array_contains("tokens", F.col("token")))
    return lost.select("sim_id", F.lit("event").alias("by"), at(F.col("k"), F.col("before")).alias("position")).unionByName(gone.select("sim_id", F.lit("branch").alias("by"), at(F.col("k"), F.col("n")).alias("position")))


def run(parameters: DataFrame, turn: bool = False) -> dict[str, DataFrame]:
    """protocol, arrays, trees and skipped of simulations (sim_id, n_leaves, gain, loss, alpha, model).

    turn: arrays of every second simulation on average are turned around; the protocol tells, 2 for turned ones.
    """
    marked = held(with_skip_reason(parameters))
    plain = marked.where(F.col("skip_reason").isNull()).drop("skip_reason")
    nodes, events = held(simulate(plain)), held(simulated_events(plain))
    leaves = nodes.where("is_leaf")
    seen = leaves.select("sim_id", F.explode("tokens").alias("token")).distinct()
    ever = nodes.select("sim_id", F.explode("tokens").alias("token")).unionByName(events.where(F.col("kind") == "gain").select("sim_id", F.explode("tokens").alias("token"))).distinct()
    unseen = ever.join(seen, ["sim_id", "token"], "left_anti").groupBy("sim_id").agg(F.sort_array(F.collect_list("token")).alias("never_seen"), F.count(F.lit(1)).alias("n_never_seen"))
    lengths = leaves.groupBy("sim_id").agg(F.avg(F.size("tokens")).alias("mean_length"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_id", F.size("tokens").alias("n"))))).alias("leaf_lengths"))
    places = loss_positions(nodes, events).groupBy("sim_id").pivot("by", ["event", "branch"]).agg(F.sort_array(F.collect_list("position"))).withColumnsRenamed({"event": "event_loss_positions", "branch": "branch_loss_positions"})
    p = plain.join(ever.groupBy("sim_id").agg(F.count(F.lit(1)).alias("n_tokens")), "sim_id", "left").join(lengths, "sim_id").join(unseen, "sim_id", "left").join(places, "sim_id", "left").na.fill(0, ["n_tokens", "n_never_seen"])
    packed = leaves.select(F.col("sim_id").alias("group_id"), F.col("node_id").alias("array_id"), "tokens")
    packed = turned(packed, "group_id") if turn else packed.withColumn("turned", F.lit(False))
    p = p.join(packed.select(F.col("group_id").alias("sim_id"), F.when(F.col("turned"), 2).otherwise(1).alias("orientation")).distinct(), "sim_id")
    arrays = packed.select("group_id", "array_id", F.posexplode("tokens").alias("pos", "token"))
    trees = nodes.select(F.col("sim_id").alias("group_id"), "node_id", "parent_id", "branch_length")
    return {"protocol": p, "arrays": arrays, "trees": trees, "skipped": marked.where(F.col("skip_reason").isNotNull())}


def turned(packed: DataFrame, *names: str, seed: int = 2357) -> DataFrame:
    """Packed arrays, each turned around or not, by a hash of its names, with `turned`."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.col(n).cast("string") for n in names)))
    out = packed.withColumn("turned", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 2 == 1)
    return out.withColumn("tokens", F.when(F.col("turned"), F.reverse("tokens")).otherwise(F.col("tokens")))


def repeated(parameters: DataFrame, runs: int) -> DataFrame:
    return parameters.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def coalescent(n: int, rng: np.random.Generator, random_lengths: bool = True) -> list[tuple[str, str | None, float]]:
    """(node, parent, branch length), parents before children: lineages s0 ... join pairwise, in_0 ... from the root."""
    live = {f"s{k}": 0.0 for k in range(n)}
    up: dict[str, tuple[str, float]] = {}
    now, at = 0.0, n - 2
    order = list(live)
    for k in range(n, 1, -1):
        mean = 2 / (k * (k - 1))
        now += rng.exponential(mean) if random_lengths else mean
        i, j = sorted(rng.choice(len(order), 2, replace=False))
        name, at = f"in_{at}", at - 1
        for x in (order[i], order[j]):
            up[x] = (name, now - live[x])
        live[name] = now
        order = [x for q, x in enumerate(order) if q not in (i, j)] + [name]
    nodes = [(order[0], None, 0.0), *((x, p, b) for x, (p, b) in up.items())]
    return sorted(nodes, key=lambda x: -live[x[0]])


def fragment_length(ratio: float, rng: np.random.Generator, limit: int = 1000) -> int:
    i = np.arange(limit + 1)
    c = (i + 1) * (i + 2) / (2 * ratio)
    with np.errstate(over="ignore"):  # far terms are 0
        p = c / np.cumprod(c + 1)
    return int(rng.choice(limit + 1, p=p / p.sum()))


def evolve(nodes: list[tuple[str, str | None, float]], rng: np.random.Generator, gain: float, loss: float, alpha: float = 1.0, model: str = "block", start: int | None = None, last_correction: bool = False, two_directional: bool = False) -> tuple[dict[str, list[int]], list[tuple]]:
    """(arrays of all nodes, events): gains at the young end; losses of one token, of a block of geometric length that
    reaches towards the young end, or of any fragment between two places.

    An event is (node, kind, time, tokens, tokens before it, their places).
    """
    if gain == 0 and loss == 0:
        raise ValueError("both rates are 0")
    if start is None:
        start = fragment_length(gain / loss, rng) if model == "fragment" else int(rng.poisson(gain / (loss * (alpha if model == "block" else 1))))
    arrays, events, fresh = {}, [], 0
    for name, parent, length in nodes:
        if parent is None:
            arrays[name], fresh = list(range(start, 0, -1)), start
            continue
        now, held = 0.0, list(arrays[parent])
        while True:
            n = len(held)
            weights = np.full(n, loss)
            if model == "block" and last_correction and n:
                weights[-1] = loss * alpha
            total = loss * n * (n + 1) / 2 if model == "fragment" else float(weights.sum())
            t_gain = rng.exponential(1 / gain) if gain else np.inf
            t_loss = rng.exponential(1 / total) if total else np.inf
            now += min(t_gain, t_loss)
            if now > length:
                break
            if t_gain < t_loss:
                fresh += 1
                held.insert(0, fresh)
                events.append((name, "gain", now, [fresh], n, [0]))
                continue
            if model == "fragment":
                a, b = sorted(rng.choice(n + 1, 2, replace=False))
            else:
                b = int(rng.choice(n, p=weights / weights.sum())) + 1
                k = int(rng.geometric(1 / alpha)) if model == "block" else 1
                if two_directional and k > b:
                    continue
                a = max(0, b - k)
            gone = held[a:b]
            events.append((name, "loss", now, gone, n, list(range(a, b))))
            del held[a:b]
        arrays[name] = held
    return arrays, events


OUT = "sim_id bigint, node_id string, parent_id string, branch_length double, is_leaf boolean, tokens array<int>"
EVENTS = "sim_id bigint, node_id string, kind string, time double, tokens array<int>, before int, places array<int>"


def _run(row) -> tuple[list, dict, list]:
    rng = np.random.default_rng([2357, int(row.sim_id), int(getattr(row, "run", 0))])
    nodes = coalescent(int(row.n_leaves), rng)
    arrays, events = evolve(nodes, rng, float(row.gain), float(row.loss), float(row.alpha), row.model)
    return nodes, arrays, events


def simulate(parameters: DataFrame) -> DataFrame:
    """A row for each node of each simulation: sim_id, n_leaves, gain, loss, alpha, model; rates of 0 are left out."""

    def run(frames):
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                nodes, arrays, _ = _run(row)
                inner = {p for _, p, _ in nodes}
                out += [(row.sim_id, x, p, b, x not in inner, arrays[x]) for x, p, b in nodes]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return parameters.where((F.col("gain") > 0) | (F.col("loss") > 0)).mapInPandas(run, OUT)


def simulated_events(parameters: DataFrame) -> DataFrame:
    """The true events of the same simulations."""

    def run(frames):
        for f in frames:
            out = [(row.sim_id, *e) for row in f.itertuples(index=False) for e in _run(row)[2]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return parameters.where((F.col("gain") > 0) | (F.col("loss") > 0)).mapInPandas(run, EVENTS)


def as_groups(simulated: DataFrame) -> DataFrame:
    """Leaves as arrays: group_id, array_id, pos, token."""
    leaves = simulated.where("is_leaf").select(F.col("sim_id").alias("group_id"), F.col("node_id").alias("array_id"), F.posexplode("tokens").alias("pos", "token"))
    return leaves


def random_orientation(arrays: DataFrame, seed: int = 2357) -> DataFrame:
    """group_id, array rows turned around for every second group on average, with `turned`; packed arrays."""
    coin = F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(2)) == 1
    return arrays.withColumn("turned", coin).withColumn("tokens", F.when(F.col("turned"), F.reverse("tokens")).otherwise(F.col("tokens")))


def branch_losses(states: DataFrame, tree: DataFrame, loss: float, seed: int = 2357) -> DataFrame:
    """Independent losses along every branch from parents' tokens: group_id, node_id, token, kept."""
    parents = states.select("group_id", F.col("node_id").alias("parent_id"), "token")
    each = parents.join(tree.select("node_id", "parent_id", "branch_length"), "parent_id")
    draw = F.pmod(F.xxhash64(F.lit(seed), "group_id", "node_id", "token"), F.lit(1 << 53)) / float(1 << 53)
    return each.select("group_id", "node_id", "token", (draw < F.exp(-loss * F.col("branch_length"))).alias("kept"))


def mutated(tokens, kind: str, a, b, c=None):
    """Array expressions: copy [a, b) beside itself, move or copy it to c, or turn it around."""
    n = F.size(tokens)
    part, left, right = F.slice(tokens, a + 1, b - a), F.slice(tokens, F.lit(1), a), F.slice(tokens, b + 1, n)
    if kind == "duplicate":
        return F.concat(left, part, part, right)
    if kind == "reverse":
        return F.concat(left, F.reverse(part), right)
    base = F.concat(left, right) if kind == "move" else tokens
    return F.concat(F.slice(base, F.lit(1), c), part, F.slice(base, c + 1, n))
