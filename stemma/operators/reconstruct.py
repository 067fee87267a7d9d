"""Ancestral presence by joint maximum likelihood, and the events it implies.

A profile has a row for each group, leaf and token: present 0 or 1. Tokens don't depend on each other, so a group's
tokens are dealt out in blocks; rows are shuffled once, and a task goes up and down its block's tree, level by level,
with all tokens of the block at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import _held
from .tree import ancestors, keys_of

CLOSE = 1e-9
#: Cells, nodes times tokens, that a task holds at once, about; one token's tree at least.
CELLS = 400_000


def _logs(gain: np.ndarray, loss: np.ndarray, t: np.ndarray) -> np.ndarray:
    """ln of the two-state chain's probabilities after time t: parent's state x child's state x places."""
    e = np.exp(-(gain + loss) * t)
    with np.errstate(divide="ignore"):
        return np.log(np.array([[loss + gain * e, gain * (1 - e)], [loss * (1 - e), gain + loss * e]]) / (gain + loss))


def _best_states(rows: pd.DataFrame, nodes: pd.DataFrame, prior: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of nodes, tokens, states, parents' states) of one group's block of tokens; ties go to state 0.

    rows: node_id, token, kind (0 absent, 1 present, 2 forced to be present); nodes in order of depth.
    """
    ids = pd.Index(nodes["node_id"])
    codes, tokens = pd.factorize(rows["token"])
    at, kind = ids.get_indexer(rows["node_id"]), rows["kind"].to_numpy()
    up, depth = ids.get_indexer(nodes["parent_id"]), nodes["depth"].to_numpy()
    n, k = len(ids), len(tokens)
    like, known, must = np.zeros((2, n, k)), np.zeros((n, k), bool), np.zeros((n, k), bool)
    tip = (at >= 0) & (kind < 2)
    for state in (0, 1):
        there = tip & (kind != state)
        like[state, at[there], codes[there]] = -np.inf
    known[at[tip], codes[tip]] = True
    held = (at >= 0) & (kind == 2)
    must[at[held], codes[held]] = True
    logs = _logs(nodes["gain"].to_numpy(), nodes["loss"].to_numpy(), nodes["branch_length"].fillna(0.0).to_numpy())
    levels = np.flatnonzero(np.diff(depth, prepend=-1, append=depth[-1] + 1))
    choice = np.zeros((2, n, k), bool)
    for a, b in list(zip(levels[:-1], levels[1:], strict=True))[::-1]:
        like[0, a:b][must[a:b]] = -np.inf
        if depth[a] == 0:
            break
        order = a + np.argsort(up[a:b], kind="stable")
        above, starts = np.unique(up[order], return_index=True)
        for parent in (0, 1):
            zero, one = (logs[parent, child, order][:, None] + like[child, order] for child in (0, 1))
            choice[parent, order] = one > zero + CLOSE
            like[parent, above] += np.add.reduceat(np.where(known[order], np.maximum(zero, one), 0.0), starts, axis=0)
        known[above] |= np.logical_or.reduceat(known[order], starts, axis=0)
    top = depth == 0
    if prior is None:  # a branch as long as the root's longest child's
        longest = nodes.loc[depth == 1, "branch_length"].max()
        prior = _logs(nodes["gain"].to_numpy()[:1], nodes["loss"].to_numpy()[:1], np.array([0.0 if longest != longest else longest]))[0, :, 0]
    states = np.zeros((n, k), bool)
    states[top] = like[1, top] + prior[1] > like[0, top] + prior[0] + CLOSE
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        if depth[a]:
            states[a:b] = np.where(states[up[a:b]], choice[1, a:b], choice[0, a:b])
    node, token = np.nonzero(known)
    return node, tokens[token], states[node, token], states[up[node], token] & (up[node] >= 0)


def joint_states(profile: DataFrame, tree: DataFrame, gain: float | str, loss: float | str, forced: DataFrame | None = None, prior: tuple[float, float] | None = None, parents: bool = False) -> DataFrame:
    """group_id, node_id, token, state for all nodes. forced: group_id, node_id, token that must be present.

    parents: one more column, `up`, has the parent's state, 0 where there is no parent; what reads it needs no join.

    gain and loss may name columns of the tree, for rates by group. A tree without group_id is that of all groups.
    prior: ln probabilities of the root's states; by default of a branch as long as the root's longest child's from 0.
    """
    keys = keys_of(tree)
    rate = lambda x: (F.col(x) if isinstance(x, str) else F.lit(float(x))).cast("double")
    nodes = tree.select(*keys, "node_id", "parent_id", F.col("branch_length").cast("double").alias("branch_length"), F.col("depth").cast("int").alias("depth"), rate(gain).alias("gain"), rate(loss).alias("loss"))
    rows = profile.select("group_id", "node_id", "token", F.col("present").cast("int").alias("kind"))
    blocks = rows.groupBy("group_id").agg(F.countDistinct("token").alias("tokens"))
    if keys:
        blocks = blocks.join(nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("nodes")), "group_id")
    else:
        blocks = blocks.withColumn("nodes", F.lit(nodes.count()))
    blocks = blocks.select("group_id", F.greatest(F.lit(1), F.least("tokens", F.ceil(F.col("tokens") * F.col("nodes") / CELLS))).cast("int").alias("blocks"))
    blocks = _held(blocks)  # a row for each group
    if forced is not None:
        rows = rows.unionByName(forced.select("group_id", "node_id", "token", F.lit(2).alias("kind")))
    rows = rows.join(blocks, "group_id").withColumn("block", F.pmod(F.xxhash64("token"), F.col("blocks")).cast("int")).drop("blocks")
    every = blocks.select(F.col("group_id").alias("group_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    nodes = every.join(nodes, "group_id") if keys else every.join(nodes)  # each block's task needs its tree
    kinds = {f.name: f.dataType.simpleString() for f in profile.schema.fields}

    def run(key: tuple, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(nodes):
            return pd.DataFrame(columns=["group_id", "node_id", "token", "state", *["up"] * parents])  # of objects: Spark can't take empty floats for texts
        nodes = nodes.sort_values("depth", kind="stable", ignore_index=True)
        at, tokens, states, ups = _best_states(rows, nodes, prior)
        out = pd.DataFrame({"node_id": nodes["node_id"].to_numpy()[at], "token": tokens, "state": states.astype(np.int32)})
        if parents:
            out["up"] = ups.astype(np.int32)
        out.insert(0, "group_id", key[0])
        return out

    by = ["group_id", "block"]
    return rows.groupBy(*by).cogroup(nodes.groupBy(*by)).applyInPandas(run, f"group_id {kinds['group_id']}, node_id {kinds['node_id']}, token {kinds['token']}, state int{', up int' * parents}")


def branch_events(states: DataFrame, tree: DataFrame) -> DataFrame:
    """group_id, node_id, token, kind: gain or loss between parent and child; the root gains all that it has. States may have `up`."""
    both = states
    if "up" not in states.columns:
        keys = keys_of(tree)
        child = states.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "node_id"])
        parent = states.select("group_id", F.col("node_id").alias("parent_id"), "token", F.col("state").alias("up"))
        both = child.join(parent, ["group_id", "parent_id", "token"], "left").withColumn("up", F.coalesce("up", F.lit(0)))
    return both.where(F.col("state") != F.col("up")).select("group_id", "node_id", "token", F.when(F.col("state") == 1, "gain").otherwise("loss").alias("kind"))


def contradictions(events: DataFrame, tree: DataFrame, order: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """group_id, node_id, token: gains below a node that gained a younger token. order: group_id, younger, older.

    above: the tree's `ancestors`, from callers that ask more than once.
    """
    gains = events.where(F.col("kind") == "gain").select("group_id", "node_id", "token")
    above = (ancestors(tree) if above is None else above).where(F.col("steps") > 0).select(*keys_of(tree), "node_id", "ancestor")
    earlier = gains.select("group_id", F.col("node_id").alias("ancestor"), F.col("token").alias("younger"))
    late = gains.join(above, [*keys_of(tree), "node_id"]).join(earlier, ["group_id", "ancestor"])
    order = order.select("group_id", "younger", F.col("older").alias("token"))
    return late.join(order, ["group_id", "younger", "token"], "left_semi").select("group_id", "node_id", "token").distinct()


def refined_states(profile: DataFrame, tree: DataFrame, order: DataFrame, gain: float | str, loss: float | str, most: int = 100, above: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, forced): reconstruct again, with what contradicts forced to be present at the parent, until none does."""
    forced, above = None, ancestors(tree) if above is None else above
    for _ in range(most):
        states = _held(joint_states(profile, tree, gain, loss, forced, parents=True))
        wrong = contradictions(branch_events(states, tree), tree, order, above).join(tree.select(*keys_of(tree), "node_id", "parent_id"), [*keys_of(tree), "node_id"])
        more = _held(wrong.select("group_id", F.col("parent_id").alias("node_id"), "token").distinct())
        if more.isEmpty():
            return states.drop("up"), forced if forced is not None else more
        forced = _held(more if forced is None else forced.unionByName(more).distinct())
    raise RuntimeError("contradictions remain")


def loss_block_tokens(states: DataFrame, tree: DataFrame, rank: DataFrame) -> DataFrame:
    """group_id, node_id, block, token: runs of lost tokens among the parent's, by rank, broken by kept tokens. States may have `up`."""
    if "up" in states.columns:
        both = states.where(F.col("up") == 1)
    else:
        keys = keys_of(tree)
        parent = states.where(F.col("state") == 1).select("group_id", F.col("node_id").alias("parent_id"), "token")
        child = states.select("group_id", "node_id", "token", "state")
        both = parent.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "parent_id"]).join(child, ["group_id", "node_id", "token"])
    both = both.join(rank, ["group_id", "token"])
    w = Window.partitionBy("group_id", "node_id").orderBy("rank")
    runs = both.withColumn("block", F.sum("state").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("state") == 0)
    return runs.select("group_id", "node_id", "block", "token")


def loss_blocks(states: DataFrame, tree: DataFrame, rank: DataFrame) -> DataFrame:
    """group_id, node_id, block, size."""
    return block_sizes(loss_block_tokens(states, tree, rank))


def partial_loss_blocks(states: DataFrame, tree: DataFrame, order: DataFrame) -> DataFrame:
    """group_id, node_id, block, token: the sets that may have been lost together under a partial order.

    A group is a unit of a task. order: group_id, younger, older.
    """
    from .align import partial_loss_sets

    keys = keys_of(tree)
    parent = states.where(F.col("state") == 1).select("group_id", F.col("node_id").alias("parent_id"), "token")
    both = parent.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "parent_id"]).join(states, ["group_id", "node_id", "token"])
    kinds = {f.name: f.dataType.simpleString() for f in states.schema.fields}

    def run(key: tuple, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        younger: dict = {}
        for x, y in zip(pairs["younger"], pairs["older"], strict=True):
            younger.setdefault(y, set()).add(x)
        out = []
        for node, part in rows.groupby("node_id"):
            lost, kept = part["token"][part["state"] == 0].tolist(), part["token"][part["state"] == 1].tolist()
            out += [(key[0], node, k, t) for k, s in enumerate(partial_loss_sets(lost, sorted(kept, key=str), younger)) for t in sorted(s, key=str)]
        return pd.DataFrame(out, columns=["group_id", "node_id", "block", "token"])

    left = both.select("group_id", "node_id", "token", "state").groupBy("group_id")
    return left.cogroup(order.select(F.col("group_id").alias("group_id"), "younger", "older").groupBy("group_id")).applyInPandas(run, f"group_id {kinds['group_id']}, node_id {kinds['node_id']}, block bigint, token {kinds['token']}")


def block_sizes(block_tokens: DataFrame) -> DataFrame:
    """group_id, node_id, block, size."""
    return block_tokens.groupBy("group_id", "node_id", "block").agg(F.count(F.lit(1)).alias("size"))


def loss_positions(states: DataFrame, tree: DataFrame, rank: DataFrame) -> DataFrame:
    """group_id, node_id, token, position of each loss: place among the parent's tokens, youngest 0, oldest 1."""
    keys = keys_of(tree)
    parent = states.where(F.col("state") == 1).select("group_id", F.col("node_id").alias("parent_id"), "token").join(rank, ["group_id", "token"])
    w = Window.partitionBy("group_id", "parent_id")
    placed = parent.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("rank"))) - 1)
    at = placed.withColumn("position", F.when(F.col("n") == 1, 1.0).otherwise(F.col("k") / (F.col("n") - 1)))
    lost = at.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "parent_id"]).join(states.where(F.col("state") == 0), ["group_id", "node_id", "token"])
    return lost.select("group_id", "node_id", "token", "position")


def offsets(states: DataFrame, tree: DataFrame, rank: DataFrame, anchor: str = "first") -> DataFrame:
    """group_id, m, present, total: over all branches, how often the parent's m-th token from an end stays.

    anchor: first or last token of the parent; first_kept or last_kept counts from the first or last that stays.
    """
    keys = keys_of(tree)
    parent = states.where(F.col("state") == 1).select("group_id", F.col("node_id").alias("parent_id"), "token").join(rank, ["group_id", "token"])
    both = parent.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "parent_id"]).join(states, ["group_id", "node_id", "token"])
    w = Window.partitionBy("group_id", "node_id")
    k = F.row_number().over(w.orderBy(F.desc("rank") if anchor.startswith("first") else F.col("rank"))) - 1
    both = both.withColumn("k", k)
    if anchor.endswith("_kept"):
        both = both.withColumn("k", F.col("k") - F.min(F.when(F.col("state") == 1, F.col("k"))).over(w)).where(F.col("k").isNotNull())
    return both.groupBy("group_id", F.col("k").alias("m")).agg(F.sum("state").alias("present"), F.count(F.lit(1)).alias("total"))


def global_offsets(states: DataFrame, tree: DataFrame, rank: DataFrame, end: str = "first") -> DataFrame:
    """group_id, m, present, total: as `offsets`, counted from the end token of all that any kept token of the group has.

    first: from the youngest token that some branch of the group keeps; last: from the oldest.
    """
    keys = keys_of(tree)
    parent = states.where(F.col("state") == 1).select("group_id", F.col("node_id").alias("parent_id"), "token").join(rank, ["group_id", "token"])
    both = parent.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "parent_id"]).join(states, ["group_id", "node_id", "token"])
    at = F.max("rank") if end == "first" else F.min("rank")
    anchor = both.where(F.col("state") == 1).groupBy("group_id").agg(at.alias("anchor"))
    m = F.col("anchor") - F.col("rank") if end == "first" else F.col("rank") - F.col("anchor")
    return both.join(anchor, "group_id").withColumn("m", m).where(F.col("m") >= 0).groupBy("group_id", "m").agg(F.sum("state").alias("present"), F.count(F.lit(1)).alias("total"))


def frequency(present: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(1 - present / total)


def moved_tokens(gains: DataFrame, guide: DataFrame) -> DataFrame:
    """group_id, n: gains that aren't a token's first (by depth, then node_id), at nodes where guide has no gain of it."""
    first = Window.partitionBy("group_id", "token").orderBy("depth", "node_id")
    again = gains.withColumn("k", F.row_number().over(first)).where(F.col("k") > 1)
    moved = again.join(guide.select("group_id", "node_id", "token"), ["group_id", "node_id", "token"], "left_anti")
    return gains.select("group_id").distinct().join(moved.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group_id", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_candidates(gains: DataFrame) -> DataFrame:
    """The first copies - 1 gains of each base token in post-order; gains: group_id, node_id, base, token, post_ord."""
    w = Window.partitionBy("group_id", "base")
    return gains.withColumn("k", F.row_number().over(w.orderBy("post_ord", "token"))).withColumn("n", F.size(F.collect_set("token").over(w))).where(F.col("k") <= F.col("n") - 1).drop("k", "n")


def without_tokens(order: DataFrame, tokens: DataFrame) -> DataFrame:
    """order (group_id, younger, older) without the pairs of such tokens."""
    t = tokens.select("group_id", "token").distinct()
    for side in ("younger", "older"):
        order = order.join(t.withColumnRenamed("token", side), ["group_id", side], "left_anti")
    return order.select("group_id", "younger", "older")


def repeated_gains(events: DataFrame) -> DataFrame:
    """group_id, repeated (gains beyond a token's first), tokens (that have some)."""
    n = events.where(F.col("kind") == "gain").groupBy("group_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("group_id").agg(F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("n") > 1).alias("tokens"))


def duplicate_classes(candidates: DataFrame) -> DataFrame:
    """A class for each candidate, from four flags on its copies: sibling_lost, sibling_here, lost_above, left_of_all."""
    kind = F.when(F.col("sibling_lost"), "rearrangement").when(F.col("sibling_here"), "duplication").when(F.col("lost_above") & F.col("left_of_all"), "reacquisition").when(F.col("left_of_all"), "independent acquisition").otherwise("other")
    return candidates.withColumn("kind", kind)


def duplicate_flags(candidates: DataFrame, states: DataFrame, events: DataFrame, tree: DataFrame, order: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """The flags of each candidate (group_id, node_id, base, token); copies of one base have tokens of one `base`.

    bases: group_id, token, base; by default a base is a token without its capital letters at the end.
    """
    keys = keys_of(tree)
    if bases is None:
        bases = states.select("group_id", "token").distinct().withColumn("base", F.regexp_replace(F.col("token").cast("string"), "[A-Z]+$", ""))
    bases = bases.select("group_id", "token", "base").distinct()
    sibling = candidates.select("group_id", "node_id", "base", "token").join(bases.select("group_id", "base", F.col("token").alias("other")), ["group_id", "base"]).where(F.col("token") != F.col("other"))
    lost = events.where(F.col("kind") == "loss").select("group_id", "node_id", F.col("token").alias("other"))
    here = states.where(F.col("state") == 1).select("group_id", "node_id", F.col("token").alias("other"))
    above = ancestors(tree).where(F.col("steps") > 0).select(*keys, "node_id", "ancestor")
    lost_above = sibling.join(above, [*keys, "node_id"]).join(lost.withColumnRenamed("node_id", "ancestor"), ["group_id", "ancestor", "other"])
    of_parent = candidates.select("group_id", "node_id", "base", "token").join(tree.select(*keys, "node_id", "parent_id"), [*keys, "node_id"]).join(here.select("group_id", F.col("node_id").alias("parent_id"), F.col("other").alias("older")), ["group_id", "parent_id"])
    not_left = of_parent.join(order.select("group_id", F.col("younger").alias("token"), "older"), ["group_id", "token", "older"], "left_anti")
    own = ["group_id", "node_id", "base", "token"]
    out = candidates
    for name, rows in (("sibling_lost", sibling.join(lost, ["group_id", "node_id", "other"])), ("sibling_here", sibling.join(here, ["group_id", "node_id", "other"])), ("lost_above", lost_above), ("right_of_some", not_left)):
        out = out.join(rows.select(*own).distinct().withColumn(name, F.lit(True)), own, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("left_of_all", ~F.col("right_of_some")).drop("right_of_some")


def leaf_only_gains(events: DataFrame, tree: DataFrame) -> DataFrame:
    """group_id, token, on_leaf: whether a token was gained on a leaf's branch."""
    keys = keys_of(tree)
    inner = tree.where(F.col("parent_id").isNotNull()).select(*keys, F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    gains = events.where(F.col("kind") == "gain").join(inner, [*keys, "node_id"], "left")
    return gains.groupBy("group_id", "token").agg(F.bool_or(F.col("inner").isNull()).alias("on_leaf"))
