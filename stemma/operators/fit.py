"""Likelihoods of branches, estimates of loss rates and block lengths, model tests, pooling.

A branch's sufficient statistics are blocks (m), lost tokens (lost), kept tokens (kept) and its length (t): its log
likelihood is m ln(p q) + (lost - m) ln(1 - q (1 - p)) - rho t kept, with p = 1 - exp(-rho t) and q = 1 / alpha.
Likelihoods of trees are sums of branches', so each is one aggregate whose partial sums form in the tasks.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.scalar import SIGNIFICANCE, chi2_quantile, unbiased_alpha

from stemma.tables import numbered_rows

from .tree import golden, keys_of


def branch_statistics(states: DataFrame, blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """group_id, node_id, t, m, lost, kept for every branch. States may have `up`."""
    keys = keys_of(tree)
    here = states.where(F.col("state") == 1)
    if "up" in states.columns:
        both = here.where(F.col("up") == 1)
    else:
        parent = here.select("group_id", F.col("node_id").alias("parent_id"), "token")
        both = parent.join(tree.select(*keys, "node_id", "parent_id"), [*keys, "parent_id"]).join(here, ["group_id", "node_id", "token"])
    kept = both.groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("kept"))
    lost = blocks.groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("lost"))
    every = states.select("group_id", "node_id").distinct().join(tree.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", F.col("branch_length").alias("t")), [*keys, "node_id"])
    out = every.join(kept, ["group_id", "node_id"], "left").join(lost, ["group_id", "node_id"], "left")
    zero = F.lit(0).cast("long")
    return out.select("group_id", "node_id", "t", *(F.coalesce(c, zero).alias(c) for c in ("m", "lost", "kept")))


def log_likelihood(rho: Column, alpha: Column, t: Column, m: Column, lost: Column, kept: Column) -> Column:
    p, q = 1 - F.exp(-rho * t), 1 / alpha
    stay = 1 - q * (1 - p)
    return F.when(m > 0, m * F.log(p * q)).otherwise(0.0) + F.when(lost > m, (lost - m) * F.log(stay)).otherwise(0.0) - rho * t * kept


def likelihood_grid(branches: DataFrame, grid: DataFrame) -> DataFrame:
    """group_id, rho, alpha, lnl for each point of a small grid (rho, alpha)."""
    each = branches.crossJoin(F.broadcast(grid)).withColumn("l", log_likelihood(*(F.col(c) for c in ("rho", "alpha", "t", "m", "lost", "kept"))))
    return each.groupBy("group_id", "rho", "alpha").agg(F.sum("l").alias("lnl"))


def pooled_statistics(branches: DataFrame, *keys: str) -> DataFrame:
    return branches.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("lost").alias("lost"), F.sum("kept").alias("kept"))


def estimates(pooled: DataFrame, t: float = 1.0, significance: float = SIGNIFICANCE) -> DataFrame:
    """Closed forms for branches of one length t: rates of both models, block length, likelihoods, test, bias correction."""
    m, lost, kept = (F.col(c).cast("double") for c in ("m", "lost", "kept"))
    rho0 = F.when((kept > 0) & (lost > 0), -F.log(kept / (lost + kept)) / t).when(lost == 0, 0.0)
    u = (kept - m) / kept
    q = m / (lost * u)
    interior = (kept > m) & (m > 0) & (q <= 1)
    rho1 = F.when(interior, -F.log(u) / t).otherwise(rho0)
    alpha = F.when(interior, 1 / q).otherwise(1.0)
    out = pooled.withColumn("rho_idm", rho0).withColumn("rho_bdm", rho1).withColumn("alpha", alpha)
    ln = lambda rho, a: log_likelihood(F.col(rho), a, F.lit(float(t)), F.col("m"), F.col("lost"), F.col("kept"))
    # A block's tokens are counted one by one by the independent model: K ln p.
    idm = F.when(F.col("lost") > 0, F.col("lost") * F.log(1 - F.exp(-F.col("rho_idm") * t))).otherwise(0.0) - F.col("rho_idm") * t * F.col("kept")
    out = out.withColumn("lnl_idm", idm).withColumn("lnl_bdm", F.greatest(ln("rho_bdm", F.col("alpha")), F.col("lnl_idm")))
    out = out.withColumn("lrt", 2 * (F.col("lnl_bdm") - F.col("lnl_idm")))
    out = out.withColumn("model", F.when(F.col("lrt") > chi2_quantile(significance), "BDM").otherwise("IDM"))
    return out.withColumn("alpha_unbiased", F.when(F.col("m") > 0, unbiased_alpha(F.col("alpha"), F.col("m"))))


def derived_rates(rho: Column, alpha: Column, length: Column) -> dict[str, Column]:
    """Loss per token, and the insertion rate that goes with the mean length."""
    return {"per_token": rho * alpha, "insertion": rho * alpha * length}


def _best_rates(rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each q, the likeliest rate and its ln likelihood; rows: t, m, lost, kept.

    The ln likelihood is concave in the rate, so its derivative has one root at most.
    """
    t, m, lost, kept = rows.T
    more = lost - m
    low, high = np.full(len(q), math.log(1e-8)), np.full(len(q), math.log(1e5))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(80):
            x = (low + high) / 2
            e = np.exp(np.exp(x)[:, None] * t)
            up = (t * (m / (e - 1) + more * q[:, None] / (e - q[:, None]) - kept)).sum(1) > 0
            low, high = np.where(up, x, low), np.where(up, high, x)
    rho = np.exp((low + high) / 2)
    p = -np.expm1(-rho[:, None] * t)
    blocks = np.where(m > 0, m * np.log(np.maximum(1e-300, p * q[:, None])), 0.0)
    return rho, (blocks + np.where(more > 0, more * np.log(np.maximum(1e-300, 1 - q[:, None] * (1 - p))), 0.0) - rho[:, None] * t * kept).sum(1)


def fit_branches(rows: list[tuple[float, int, int, int]]) -> dict[str, float]:
    """Both models fitted to branches (t, m, lost, kept) of any lengths: a grid over ln alpha that narrows around the
    best one, with the best rate for each of its points."""
    held = np.array([r for r in rows if r[0] > 0], float).reshape(-1, 4)
    if not held[:, 2].any():
        return {"rho_idm": 0.0, "lnl_idm": 0.0, "rho_bdm": 0.0, "alpha": 1.0, "lnl_bdm": 0.0, "lrt": 0.0}
    low, high, points = 0.0, math.log(1e3), 257
    for _ in range(9):
        x = np.linspace(low, high, points)
        rho, lnl = _best_rates(held, np.exp(-x))
        best = int(lnl.argmax())
        low, high, points = x[max(0, best - 1)], x[min(points - 1, best + 1)], 33
    (r0,), (l0,) = (y.tolist() for y in _best_rates(held, np.ones(1)))
    r1, alpha, l1 = float(rho[best]), float(np.exp(x[best])), float(lnl[best])
    if l1 < l0:
        r1, alpha, l1 = r0, 1.0, l0
    return {"rho_idm": r0, "lnl_idm": l0, "rho_bdm": r1, "alpha": alpha, "lnl_bdm": l1, "lrt": 2 * (l1 - l0)}


FITTED = "rho_idm double, lnl_idm double, rho_bdm double, alpha double, lnl_bdm double, lrt double"


def fit(branches: DataFrame, *keys: str) -> DataFrame:
    """keys and both models' estimates; branches of equal length are summed up before they meet in one task."""
    summed = branches.groupBy(*keys, "t").agg(F.sum("m").alias("m"), F.sum("lost").alias("lost"), F.sum("kept").alias("kept"))
    kinds = {f.name: f.dataType.simpleString() for f in branches.schema.fields}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        got = fit_branches(sorted(tuple(x) for x in frame[["t", "m", "lost", "kept"]].itertuples(index=False)))
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), **got}])

    return summed.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), FITTED]))


def chunked(groups: DataFrame, size: int, order: str = "group_id") -> DataFrame:
    """Pool numbers for groups in order, `size` to a pool; what is left over joins the last pool."""
    out = numbered_rows(groups, "__k", order)
    n = max(1, out.count() // size)
    return out.withColumn("pool", F.least(F.floor(F.col("__k") / size), F.lit(n - 1).cast("long"))).drop("__k")


def with_total(pooled_input: DataFrame, *keys: str) -> DataFrame:
    """Sums for every key and one row over all (nulls in the keys)."""
    return pooled_input.rollup(*keys).agg(F.sum("m").alias("m"), F.sum("lost").alias("lost"), F.sum("kept").alias("kept")).where(F.grouping_id().isin(0, 2 ** len(keys) - 1))


def unseen_probability(tree: DataFrame, gains: DataFrame, rho: float) -> DataFrame:
    """group_id, node_id, unseen: that a token gained at node is in no leaf below: products of children.

    A tree is a unit of a task, which goes up through it level by level.
    """
    keys = keys_of(tree)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("depth", kind="stable", ignore_index=True)
        up, depth = pd.Index(frame["node_id"]).get_indexer(frame["parent_id"]), frame["depth"].to_numpy()
        stays, product, inner = np.exp(-rho * frame["branch_length"].to_numpy(float)), np.ones(len(frame)), np.zeros(len(frame), bool)
        for d in range(int(depth[-1]), 0, -1):
            here = np.flatnonzero(depth == d)
            np.multiply.at(product, up[here], 1 - stays[here] * (1 - np.where(inner[here], product[here], 0.0)))
            inner[up[here]] = True
        return frame[[*keys, "node_id"]].assign(unseen=np.where(inner, product, 0.0))

    kinds = {f.name: f.dataType.simpleString() for f in tree.schema.fields}
    grouped = tree.select(*keys, "node_id", "parent_id", "branch_length", "depth").groupBy(*(keys or [F.lit(0).alias("tree")]))
    out = grouped.applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"node_id {kinds['node_id']}", "unseen double"]))
    return gains.join(out, [*keys, "node_id"])


def fit_corrected(branches: list[tuple[float, int, int, int]], tree: list[tuple[str, str | None, float]], gains: dict[str, int]) -> tuple[float, float]:
    """(rho, shift): the independent model's rate refitted with 1 / (1 - P(unseen)) for each gain, and its shift.

    Gains are matched to their branches by node.
    """
    children: dict[str, list[tuple[str, float]]] = {}
    for n, p, b in tree:
        if p is not None:
            children.setdefault(p, []).append((n, b))
    order, todo = [], [n for n, p, _ in tree if p is None]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c, _ in children.get(x, [])]

    def value(rho: float) -> float:
        seen: dict[str, float] = {}  # from logarithms: the chance of being seen may be far below the digits of 1
        for x in reversed(order):
            gone = [math.exp(-rho * b) * seen[c] for c, b in children.get(x, [])]
            seen[x] = (1.0 if any(g >= 1 for g in gone) else -math.expm1(sum(math.log1p(-g) for g in gone))) if x in children else 1.0
        total = -sum(k * math.log(max(1e-300, seen[n])) for n, k in gains.items() if k)
        for t, _, lost, kept in branches:
            total += (lost * math.log(max(1e-300, -math.expm1(-rho * t))) if lost and t > 0 else 0.0) - rho * t * kept
        return total

    plain = fit_branches(branches)["rho_idm"]
    rho = math.exp(golden(lambda x: value(math.exp(x)), math.log(1e-8), math.log(1e4), close=1e-11))
    return rho, rho - plain


def corrected(branches: DataFrame, tree: DataFrame, gains: DataFrame) -> DataFrame:
    """group_id, rho, shift of `fit_corrected` for each group; gains: group_id, node_id, gains. A group is a unit."""
    kind = branches.schema["group_id"].dataType.simpleString()
    rows = branches.select("group_id", "node_id", F.lit(None).cast("string").alias("parent_id"), "t", "m", "lost", "kept", F.lit(0).cast("long").alias("gains"), F.lit("branch").alias("row"))
    none = F.lit(0).cast("long")
    rows = rows.unionByName(tree.select("group_id", "node_id", "parent_id", F.col("branch_length").alias("t"), none.alias("m"), none.alias("lost"), none.alias("kept"), none.alias("gains"), F.lit("node").alias("row")))
    rows = rows.unionByName(gains.select("group_id", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("t"), none.alias("m"), none.alias("lost"), none.alias("kept"), "gains", F.lit("gains").alias("row")))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        of = lambda row, *columns: list(frame.loc[frame["row"] == row, list(columns)].itertuples(index=False, name=None))
        nodes = [(n, None if p is None or p != p else p, t) for n, p, t in of("node", "node_id", "parent_id", "t")]
        rho, shift = fit_corrected(sorted(of("branch", "t", "m", "lost", "kept")), sorted(nodes, key=lambda x: x[0]), dict(sorted(of("gains", "node_id", "gains"))))
        return pd.DataFrame({"group_id": [key[0]], "rho": [rho], "shift": [shift]})

    return rows.groupBy("group_id").applyInPandas(run, f"group_id {kind}, rho double, shift double")


# --- Blocks under the death process: losses that later join into one ---------------------------------------------


def death_likelihoods(rho: float, alpha: float, t: float, longest: int) -> list[float]:
    """Probabilities that 0, 1, ... `longest` neighbours are lost within t, next to a token that stays.

    They solve p_i' = rho / alpha * sum over k < i of (1 - 1 / alpha)^(i - k - 1) (k + 1) p_k - i rho p_i, p_0 = 1, so
    each is a sum of exp(-j rho t), j up to i, whose coefficients follow from the shorter ones'. Their signs alternate:
    digits are kept as needed.
    """
    with localcontext() as c:
        c.prec = 30 + 2 * longest
        a, g = Decimal(alpha), 1 - 1 / Decimal(alpha)
        powers = [Decimal(1)]
        for _ in range(longest):
            powers.append(powers[-1] * g)
        step = Decimal(-rho * t).exp()
        e = [Decimal(1)]
        for _ in range(longest):
            e.append(e[-1] * step)
        parts: list[list[Decimal]] = [[Decimal(1)]]
        for i in range(1, longest + 1):
            sums = [sum((powers[i - k - 1] * (k + 1) * parts[k][j] for k in range(j, i)), Decimal(0)) / a for j in range(i)]
            mine = [sums[j] / (i - j) for j in range(i)]
            parts.append([*mine, -sum(mine)])
        return [float(sum(x * y for x, y in zip(p, e, strict=False))) for p in parts]


def precise_log_likelihood(rho: float, alpha: float, branches: list[tuple[float, int, list[int]]]) -> float:
    """Of branches (t, kept tokens, block sizes)."""
    out, known = 0.0, {}
    longest = {}
    for t, _, sizes in branches:
        longest[t] = max([longest.get(t, 0), *sizes])
    for t, kept, sizes in branches:
        if t not in known:
            known[t] = death_likelihoods(rho, alpha, t, longest[t])
        out += sum(math.log(max(1e-40, known[t][k])) for k in sizes) - rho * t * kept
    return out


def fit_precise(branches: DataFrame, *keys: str) -> DataFrame:
    """keys, rho, alpha, lnl of the death process; branches: keys, t, kept, sizes (array). Groups are bounded."""
    kinds = {f.name: f.dataType.simpleString() for f in branches.schema.fields}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(float(t), int(k), [int(x) for x in s]) for t, k, s in zip(frame.t, frame.kept, frame.sizes, strict=True) if t > 0]
        if not any(s for *_, s in rows):
            return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "rho": 0.0, "alpha": 1.0, "lnl": 0.0}])
        value = lambda x, a: precise_log_likelihood(math.exp(x), math.exp(a), rows)
        x, a = math.log(0.1), 0.3
        for width in (3.0, 1.0, 0.3, 0.1, 0.03, 0.01):  # a shrinking cross around the best point
            for _ in range(12):
                best = max(((value(x + dx, max(0.0, a + da)), x + dx, max(0.0, a + da)) for dx, da in ((0, 0), (width, 0), (-width, 0), (0, width), (0, -width), (width, -width), (-width, width))), key=lambda v: v[0])
                if (best[1], best[2]) == (x, a):
                    break
                x, a = best[1:]
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "rho": math.exp(x), "alpha": math.exp(a), "lnl": value(x, a)}])

    return branches.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "rho double, alpha double, lnl double"]))
