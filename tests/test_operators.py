import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions.scalar import decision
from stemma.operators import align, analysis, arrays, cluster, filters, fit, orient, reconstruct, simulate, tree


def long(spark, held, group="g"):
    return spark.createDataFrame([(group, a, i, t) for a, ts in held.items() for i, t in enumerate(ts)], "group_id string, array_id string, pos int, token string")


def test_closure_and_cycles(spark):
    a = long(spark, {"A": "321", "B": "4217", "C": "6527"})
    edges = {(r.src, r.dst) for r in arrays.edges(a).collect()}
    assert edges == {("3", "2"), ("2", "1"), ("4", "2"), ("1", "7"), ("6", "5"), ("5", "2"), ("2", "7")}
    order = arrays.closure(arrays.edges(a))
    assert order.count() == 16
    rank = {r.token: r["rank"] for r in arrays.topological_rank(a, order).collect()}
    assert all(rank[r.older] < rank[r.younger] for r in order.collect())
    with pytest.raises(arrays.CycleError):
        arrays.closure(arrays.edges(long(spark, {"A": "65227"})))
    aligned = {(r.array_id, r.col): r.token for r in arrays.align_on_order(a, arrays.topological_rank(a, order)).collect()}
    for name, tokens in {"A": "321", "B": "4217", "C": "6527"}.items():
        assert "".join(t for (x, _), t in sorted(aligned.items(), key=lambda i: i[0][1]) if x == name) == tokens


def aligned(spark, rows):
    return spark.createDataFrame([("g", a, i, t) for a, ts in rows.items() for i, t in enumerate(ts.split()) if t != "-"], "group_id string, array_id string, col int, token string")


def test_pair_counts(spark):
    pairs = spark.createDataFrame([("g", "A", "B")], "group_id string, a string, b string")
    r = arrays.pair_counts(aligned(spark, {"A": "- - - 3 2 1 -", "B": "- - 4 - 2 1 7"}), pairs).first()
    assert (r.fes, r.gains_a, r.gains_b, r.keeps_a, r.keeps_b, r.runs_a, r.runs_b) == (4, 1, 1, 2, 3, [1], [])
    r = arrays.pair_counts(aligned(spark, {"A": "1 - - 4 -", "B": "1 2 3 4 5"}), pairs).first()
    assert (r.keeps_a, r.keeps_b, r.runs_a, r.runs_b) == (2, 5, [2, 1], [])
    r = arrays.pair_counts(aligned(spark, {"A": "1 - - - 5", "B": "1 2 - 4 5"}), pairs).first()
    assert (r.runs_a, r.keeps_a, r.keeps_b) == ([2], 2, 4)
    assert tree.pair_distances(arrays.pair_counts(aligned(spark, {"A": "1 - - 4 -", "B": "1 2 3 4 5"}), pairs)).first().distance > tree.MIN_BRANCH


def test_dedup_and_names(spark):
    got = {r.representative: r.members for r in arrays.dedup(long(spark, {"n1": "ab", "n2": "ab", "n3": "c"})).collect()}
    assert got == {"n1": ["n1", "n2"], "n3": ["n3"]}
    names = [r.name for r in arrays.duplicate_names(long(spark, {"x": "aba"})).orderBy("pos").collect()]
    assert names == ["aA", "b", "aB"]
    assert [r.token for r in arrays.unique_in_order(long(spark, {"x": "abac"})).orderBy("pos").collect()] == list("abc")
    assert [r.token for r in arrays.reversed_arrays(long(spark, {"x": "abc"})).orderBy("pos").collect()] == list("cba")
    sel = arrays.group_selection(long(spark, {"x": "a"}), [("minimum_array_number", 2)]).first()
    assert sel.skip_reason == "minimum_array_number"
    with pytest.raises(ValueError):
        arrays.group_selection(long(spark, {"x": "a"}), [("nonsense", 2)])


def test_clusters(spark):
    rows = spark.createDataFrame([("r", 0, "AAAA"), ("r", 1, "AATT"), ("r", 2, "AAAT")], "repeat string, ord int, seq string")
    assert {(r.seq, r.representative) for r in cluster.greedy_leader(rows, "seq", 1).collect()} == {("AAAA", "AAAA"), ("AAAT", "AAAA"), ("AATT", "AATT")}
    assert {r.representative for r in cluster.single_linkage(rows, "seq", 1).collect()} == {"AAAA"}
    a = long(spark, {"X": "12", "Y": "34", "Z": "23"})
    assert {r.array_id: r.cluster for r in cluster.greedy_overlap(a).collect()} == {"X": "g_0", "Z": "g_0", "Y": "g_1"}
    assert {r.component for r in cluster.overlap_components(a).collect()} == {"X"}


def test_similar_pairs_miss_nothing(spark):
    import random

    random.seed(5)
    words = sorted({"".join(random.choice("AC") for _ in range(random.randint(1, 9))) for _ in range(120)})
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for most in (1, 2, 3):
        want = {(a, b) for a, b in itertools.combinations(words, 2) if cluster.edit_distance(a, b, most) <= most}
        assert {(r.a, r.b) for r in cluster.similar_pairs(rows, "w", most).collect()} == want


def small_tree(spark):
    nodes = [("root", None, 0.0, 0), ("x", "root", 1.0, 1), ("y", "root", 0.5, 1), ("a", "x", 1.0, 2), ("b", "x", 0.7, 2), ("c", "y", 1.5, 2), ("d", "y", 0.3, 2)]
    return nodes, spark.createDataFrame(nodes, "node_id string, parent_id string, branch_length double, depth int")


def test_joint_states_are_the_best_of_all(spark):
    nodes, t = small_tree(spark)
    gain, loss = 0.4, 0.3
    patterns = list(itertools.product((0, 1), repeat=4))
    profile = spark.createDataFrame([("g", n, i, p) for i, ps in enumerate(patterns) for n, p in zip("abcd", ps, strict=True)], "group_id string, node_id string, token int, present int")
    got = {}
    for r in reconstruct.joint_states(profile, t, gain, loss).collect():
        got.setdefault(r.token, {})[r.node_id] = r.state

    def p(s, c, b):
        a, e = gain + loss, math.exp(-(gain + loss) * b)
        return {(0, 0): loss + gain * e, (0, 1): gain * (1 - e), (1, 0): loss * (1 - e), (1, 1): gain + loss * e}[s, c] / a

    def lnl(states):
        return math.log(p(0, states["root"], 1.0)) + sum(math.log(p(states[q], states[n], b)) for n, q, b, _ in nodes if q)

    for i, ps in enumerate(patterns):
        leaves = dict(zip("abcd", ps, strict=True))
        best = max(lnl({**leaves, "root": r, "x": x, "y": y}) for r, x, y in itertools.product((0, 1), repeat=3))
        assert math.isclose(lnl(got[i]), best, rel_tol=1e-9)


def test_joint_states_with_blocks_without_tokens(spark, monkeypatch):
    """Tokens are dealt out by hash, so one of several blocks may get none; every block has its tree all the same."""
    _, t = small_tree(spark)
    profile = spark.createDataFrame([("g", n, i, (i >> k) % 2) for i in range(16) for k, n in enumerate("abcd")], "group_id string, node_id string, token int, present int")
    rows = lambda: {tuple(r) for r in reconstruct.joint_states(profile, t, 0.4, 0.3).collect()}
    whole = rows()
    monkeypatch.setattr(reconstruct, "CELLS", 1)
    used = profile.select(F.expr("pmod(xxhash64(token), 16)")).distinct().count()
    assert used < 16 and rows() == whole and len(whole) == 16 * 7


def test_states_with_their_parents_need_no_join(spark):
    """`up` gives the events, blocks and counts of the joins with the tree, without shuffling the states for it."""
    _, t = small_tree(spark)
    profile = spark.createDataFrame([("g", n, i, (i >> k) % 2) for i in range(16) for k, n in enumerate("abcd")], "group_id string, node_id string, token int, present int")
    rank = profile.select("group_id", "token", F.col("token").alias("rank")).distinct()
    full = reconstruct.joint_states(profile, t, 0.4, 0.3, parents=True)
    plain, rows = full.drop("up"), lambda df: sorted(map(tuple, df.collect()))
    assert rows(plain) == rows(reconstruct.joint_states(profile, t, 0.4, 0.3))
    assert rows(reconstruct.branch_events(full, t)) == rows(reconstruct.branch_events(plain, t))
    blocks = [reconstruct.loss_blocks(s, t, rank) for s in (full, plain)]
    assert rows(blocks[0]) == rows(blocks[1])
    assert rows(fit.branch_statistics(full, blocks[0], t)) == rows(fit.branch_statistics(plain, blocks[1], t))
    held = arrays._held(full)
    assert "Join" not in reconstruct.branch_events(held, t)._jdf.queryExecution().optimizedPlan().toString()


def test_refined_states_are_read_with_their_parents(spark, monkeypatch):
    """Each round takes events from `up`; the states that come back are as ever."""
    _, t = small_tree(spark)
    profile = spark.createDataFrame([("g", n, i, (i >> k) % 2) for i in range(16) for k, n in enumerate("abcd")], "group_id string, node_id string, token int, present int")
    seen, events = [], reconstruct.branch_events
    monkeypatch.setattr(reconstruct, "branch_events", lambda states, tree: (seen.append("up" in states.columns), events(states, tree))[1])
    order = spark.createDataFrame([("g", 1, 2)], "group_id string, younger int, older int")
    states = reconstruct.refined_states(profile, t, order, 0.4, 0.3)[0]
    assert seen and all(seen) and states.columns == ["group_id", "node_id", "token", "state"]


def test_sizes_of_held_tables_follow_their_rows(spark):
    """Many rows of few values must not look small enough to be broadcast through the driver."""
    from stemma.tables import held

    rows = spark.range(400_000).select(F.lit("view").alias("group_id"), F.concat(F.lit("u"), F.col("id") % 900).alias("node_id"), (F.col("id") % 10).cast("int").alias("token"), F.lit(1).alias("state"))
    kept = held(rows.coalesce(1).sortWithinPartitions("node_id"))
    assert int(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 400_000 and kept.count() == 400_000


def test_events_blocks_and_positions(spark):
    t = spark.createDataFrame([("p", None, 0.0, 0), ("c", "p", 1.0, 1)], "node_id string, parent_id string, branch_length double, depth int")
    kept = {6, 3, 1}
    states = spark.createDataFrame([("g", n, k, int(n == "p" or k in kept)) for n in "pc" for k in range(1, 7)], "group_id string, node_id string, token int, state int")
    rank = spark.createDataFrame([("g", k, k) for k in range(1, 7)], "group_id string, token int, rank int")
    blocks = reconstruct.loss_blocks(states, t, rank)
    assert sorted(r["size"] for r in blocks.collect()) == [1, 2]
    stats = fit.branch_statistics(states, blocks, t).where("node_id = 'c'").first()
    assert (stats.m, stats.lost, stats.kept) == (2, 3, 3)
    assert sorted(round(r.position, 6) for r in reconstruct.loss_positions(states, t, rank).collect()) == [0.2, 0.4, 0.8]
    present = lambda anchor: sorted(r.m for r in reconstruct.offsets(states, t, rank, anchor).collect() if r.present)
    assert present("first") == [0, 3, 5] and present("last") == [0, 2, 5]
    events = reconstruct.branch_events(states, t)
    assert {(r.token, r.kind) for r in events.where("node_id = 'c'").collect()} == {(2, "loss"), (4, "loss"), (5, "loss")}


def test_contradictions_and_refinement(spark):
    nodes = [("root", None, 0.0, 0), ("x", "root", 1.0, 1), ("y", "root", 1.0, 1)]
    t = spark.createDataFrame(nodes, "node_id string, parent_id string, branch_length double, depth int")
    order = spark.createDataFrame([("g", 3, 2)], "group_id string, younger int, older int")
    events = spark.createDataFrame([("g", "root", 3, "gain"), ("g", "x", 2, "gain")], "group_id string, node_id string, token int, kind string")
    assert [(r.node_id, r.token) for r in reconstruct.contradictions(events, t, order).collect()] == [("x", 2)]
    profile = spark.createDataFrame([("g", "x", 3, 1), ("g", "y", 3, 1), ("g", "x", 2, 1), ("g", "y", 2, 0)], "group_id string, node_id string, token int, present int")
    states, forced = reconstruct.refined_states(profile, t, order, 1e-4, 1e-3)
    assert {(r.node_id, r.token) for r in forced.collect()} <= {("root", 2)}
    assert reconstruct.contradictions(reconstruct.branch_events(states, t), t, order).isEmpty()


def test_duplicate_classes(spark):
    nodes = [("root", None, 0.0, 0), ("x", "root", 1.0, 1)]
    t = spark.createDataFrame(nodes, "node_id string, parent_id string, branch_length double, depth int")
    states = spark.createDataFrame([("g", n, k, s) for n, k, s in [("root", "5A", 1), ("root", "5B", 0), ("root", "7", 1), ("x", "5A", 1), ("x", "5B", 1), ("x", "7", 1)]], "group_id string, node_id string, token string, state int")
    events = reconstruct.branch_events(states, t)
    gains = spark.createDataFrame([("g", "x", "5", "5B", 0), ("g", "root", "5", "5A", 1)], "group_id string, node_id string, base string, token string, post_ord int")
    c = reconstruct.duplicate_candidates(gains)
    assert [r.token for r in c.collect()] == ["5B"]
    order = spark.createDataFrame([("g", "5B", "5A"), ("g", "5B", "7")], "group_id string, younger string, older string")
    flags = reconstruct.duplicate_flags(c.select("group_id", "node_id", "base", "token"), states, events, t, order)
    assert reconstruct.duplicate_classes(flags).first().kind == "duplication"


def test_estimates(spark):
    pooled = spark.createDataFrame([("g", 2, 4, 6), ("h", 0, 0, 5)], "group_id string, m long, lost long, kept long")
    r = {x.group_id: x for x in fit.estimates(pooled).collect()}
    g = r["g"]
    assert [round(x, 6) for x in (g.rho_idm, g.lnl_idm, g.rho_bdm, g.alpha, g.lnl_bdm, g.lrt)] == [0.510826, -6.730117, 0.405465, 1.333333, -6.591674, 0.276886] and g.model == "IDM"
    assert r["h"].rho_idm == 0 and r["h"].model == "IDM"
    got = fit.fit_branches([(1.0, 2, 4, 6)])
    assert math.isclose(got["rho_bdm"], 0.405465, abs_tol=1e-4) and math.isclose(got["alpha"], 4 / 3, abs_tol=1e-3) and math.isclose(got["lnl_idm"], -6.730117, abs_tol=1e-5)


def test_rate_correction():
    rho, shift = fit.fit_corrected([(1.0, 2, 4, 6), (1.0, 1, 1, 5)], [("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 1.0)], {"r": 5, "a": 2, "b": 2})
    assert rho > 0 and shift > 0


def test_trees(spark):
    nodes, t = small_tree(spark)
    m = tree.metrics(t).first()
    assert (m.total_length, m.min_length, m.max_length, m.height, m.n_leaves, m.ultrametric) == (5.0, 0.3, 1.5, 2.0, 4, False)
    d = {(r.a, r.b): r.distance for r in tree.leaf_distances(t, tree.leaves(t)).collect()}
    assert math.isclose(d["b", "a"], 1.7) and math.isclose(d["c", "a"], 4.0)
    assert {r.node_id: r.n_leaves for r in tree.leaf_counts(t).collect()}["root"] == 4
    assert tree.with_depth(t.drop("depth")).where("node_id = 'd'").first().depth == 2

    def path(out, x, y):
        up = {n: (p, b) for n, p, b in out}
        way = lambda n: [] if up[n][0] is None else [(n, up[n][1]), *way(up[n][0])]
        a, b = dict(way(x)), dict(way(y))
        return sum(v for k, v in a.items() if k not in b) + sum(v for k, v in b.items() if k not in a)

    names = ["a", "b", "c", "d"]
    for out in (tree.neighbour_joining(names, {k: v for k, v in d.items()}), tree.midpoint(tree.neighbour_joining(names, {k: v for k, v in d.items()}))):
        assert all(math.isclose(path(out, x, y), v, abs_tol=1e-5) for (x, y), v in d.items())
    u = tree.upgma(["a", "b", "c"], {("b", "a"): 2.0, ("c", "a"): 6.0, ("c", "b"): 8.0})
    assert math.isclose(path(u, "a", "b"), 2.0) and math.isclose(path(u, "a", "c"), 7.0)
    far = spark.createDataFrame([("g", a, b, v) for (a, b), v in d.items()], "group_id string, a string, b string, distance double")
    assert tree.build_trees(far, "nj").where("parent_id is null").count() == 1


def test_group_distances_of_all_pairs(spark):
    """Over ids of several blocks of 20, with tokens that differ in a column, against the counts of each pair."""
    import random

    r = random.Random(5)
    rows = [(g, 7 * k, c, r.choice([c, c, c, 50 + c])) for g, n in (("g", 30), ("h", 2), ("lone", 1)) for k in range(n) for c in range(12) if r.random() < 0.5]
    alignment = spark.createDataFrame(rows, "group_id string, array_id long, col int, token int")
    ids = {g: sorted({x[1] for x in rows if x[0] == g}) for g in ("g", "h", "lone")}
    pairs = spark.createDataFrame([(g, a, b) for g, of in ids.items() for a in of for b in of if a > b], "group_id string, a long, b long")
    got = {(x.group_id, x.a, x.b): x.distance for x in tree.group_distances(alignment).collect()}
    want = {(x.group_id, x.a, x.b): x.distance for x in tree.pair_distances(arrays.pair_counts(alignment, pairs)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(v, want[k], rel_tol=1e-8) for k, v in got.items())
    assert len(got) == sum(len(v) * (len(v) - 1) // 2 for v in ids.values())


def with_copies(spark):
    """Groups whose arrays are copies in part, one of two equal arrays, one of one array."""
    import random

    r = random.Random(9)
    rows = []
    for g, n, kinds in (("g", 30, 8), ("h", 9, 9), ("twice", 2, 1), ("lone", 1, 1)):
        seen = [[(c, c) for c in range(12) if c == k or r.random() < 0.5] for k in range(kinds)]
        rows += [(g, 7 * k, c, t) for k in range(n) for c, t in (seen[k] if k < kinds else r.choice(seen))]
    return rows, spark.createDataFrame(rows, "group_id string, array_id long, col int, token int")


def test_equal_arrays_are_compared_once(spark):
    rows, alignment = with_copies(spark)
    ids = {g: sorted({x[1] for x in rows if x[0] == g}) for g in ("g", "h", "twice", "lone")}
    pairs = spark.createDataFrame([(g, a, b) for g, of in ids.items() for a in of for b in of if a > b], "group_id string, a long, b long")
    classes = tree.array_classes(alignment)
    assert {r.group_id: r["count"] for r in classes.groupBy("group_id").count().collect()} == {"g": 8, "h": 9, "twice": 1, "lone": 1}
    assert tree.class_distances(classes).count() == 8 * 7 // 2 + 9 * 8 // 2
    got = {(x.group_id, x.a, x.b): x.distance for x in tree.group_distances(alignment).collect()}
    want = {(x.group_id, x.a, x.b): x.distance for x in tree.pair_distances(arrays.pair_counts(alignment, pairs)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(v, want[k], rel_tol=1e-8) for k, v in got.items())


def test_average_linkage_of_classes(spark):
    """The tree of classes has the clusters and heights of that of all pairs, copies included."""
    _, alignment = with_copies(spark)

    def clusters(trees):
        up = {(r.group_id, r.node_id): (r.parent_id, r.branch_length) for r in trees.collect()}
        inner, out = {(g, p) for (g, _), (p, _) in up.items()}, {}
        for g, n in up.keys() - inner:
            at, high = n, 0.0
            while at is not None:
                out.setdefault((g, at), (set(), []))[0].add(n)
                out[g, at][1].append(high)
                at, high = up[g, at][0], high + up[g, at][1]
        assert all(max(h) - min(h) < 1e-9 for _, h in out.values())
        return {(g, frozenset(below)): round(h[0], 9) for (g, _), (below, h) in out.items()}

    got, want = tree.array_trees(alignment), tree.build_trees(tree.group_distances(alignment))
    assert got.count() == want.count() == 59 + 17 + 3
    a, b = clusters(got), clusters(want)
    whole = lambda x: {k: v for k, v in x.items() if v > 1e-6}
    assert whole(a) == whole(b) and len(whole(a)) == 7 + 8
    assert {k for k in a if len(k[1]) == 1} == {k for k in b if len(k[1]) == 1}


def plain_neighbour_joining(n, d, least):
    """Every criterion anew for every join."""
    d, live, out, at = [list(map(float, r)) for r in d], [str(k) for k in range(n)], [], 0
    while len(live) > 2:
        n, total = len(live), [float(sum(map(np.longdouble, r), np.longdouble(0))) for r in d]
        _, i, j = min((d[i][j] * (n - 2) - total[i] - total[j], i, j) for i in range(n) for j in range(i))
        v, at = d[i][j], at + 1
        x = (v + (total[i] - total[j]) / (n - 2)) / 2
        out += [(live[i], f"Inner{at}", max(least, x)), (live[j], f"Inner{at}", max(least, v - x))]
        row = [(a + b - v) / 2 for a, b in zip(d[i], d[j], strict=True)]
        row[j] = 0.0
        for k in range(n):
            d[j][k] = d[k][j] = row[k]
        live[j] = f"Inner{at}"
        del live[i], d[i]
        for r in d:
            del r[i]
    return out


def test_neighbour_joining_by_bounds(spark):
    rng = np.random.default_rng(3)
    for n in (3, 4, 7, 20, 33):
        d = np.tril(rng.integers(1, 2**20, (n, n)), -1) / 2**20
        d = d + d.T
        got = tree.neighbour_joining([str(k) for k in range(n)], d)
        assert got[: 2 * (n - 2)] == plain_neighbour_joining(n, d, tree.MIN_BRANCH)
    _, alignment = with_copies(spark)
    got, want = tree.array_trees(alignment, method="nj"), tree.build_trees(tree.group_distances(alignment), "nj")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_neighbour_joining_looks_at_few_rows():
    """Of some hundred rows, a join looks through a few; a whole look at each join would take 300 * 300 / 2."""
    looked, plain = [], np.ndarray

    class Counted(plain):
        def argmin(self, *a, **k):
            looked.append(len(self))
            return plain.argmin(self.view(plain), *a, **k)

    rng = np.random.default_rng(4)
    x = rng.random((300, 60)) < 0.5
    d = (x[:, None] != x).sum(2) / 7.0
    tree.neighbour_joining([str(k) for k in range(300)], np.concatenate([d[k, :k] for k in range(300)]).view(Counted))
    assert 300 <= len(looked) < 300 * 300 / 8


def held_rows(monkeypatch, module):
    """Collects the rows of every table that the module writes."""
    counts, held = [], module._held

    def counted(df):
        out = held(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(module, "_held", counted)
    return counts


def plain_sides(a, b):
    """Gains, kept tokens, deletion runs and their tokens of a against b, from {column: token} by plain loops."""
    first = min((c for c in a if b.get(c) == a[c]), default=math.inf)
    runs, run = [], 0
    for c in sorted(c for c in {*a, *b} if c >= first):
        if c in a:
            runs.append(run)
            run = 0
        else:
            run += 1
    runs = [r for r in [*runs, run] if r]
    return [sum(c < first for c in a), sum(c >= first for c in a), len(runs), sum(runs)]


def test_sides_by_words_of_bits(monkeypatch):
    """Over several words, with runs and gaps across their borders, arrays without columns, several tokens in a column."""
    import random

    from stemma.functions.scalar import SIMPLE_DISTANCE

    r = random.Random(6)
    cells = [{c: r.choice([c, c, 500 + c]) for c in range(200) if r.random() < r.choice([0.0, 0.02, 0.3, 0.9])} for _ in range(40)]
    cells += [{0: 0, 63: 63, 64: 64}, {0: 0, 64: 64, 127: 127, 199: 199}, {0: 0, 199: 199}, {63: 7}, {}, dict.fromkeys(range(200), 1)]
    rates = [SIMPLE_DISTANCE[x] for x in ("gain", "loss", "alpha")]
    far = tree._Distances([np.array(list(x), int) for x in cells], [np.array(list(x.values()), int) for x in cells], *rates)
    want = []
    for i, a in enumerate(cells):
        got = far._sides(i, slice(0, len(cells)))
        for j, b in enumerate(cells):
            both = [plain_sides(a, b), plain_sides(b, a)]
            assert got[:, :, j].tolist() == both
            want += [float(np.clip(sum(tree.side_times(*([x] for x in s), *rates)[0] for s in both), tree.MIN_BRANCH, 20.0))] * (j < i)
    assert np.allclose(far.lower(), want, rtol=1e-9)
    monkeypatch.setattr(tree, "PAIRS", 7)
    assert np.allclose(far.lower(), want, rtol=1e-9)
    far.sizes[0] = 60_000  # as if of an array of so many tokens: counts that don't fit a number
    assert np.allclose(far._fitted(far._sides(3, slice(4, 9))[0]), tree.side_times(*far._sides(3, slice(4, 9))[0], *rates))


@pytest.mark.parametrize("method", ["upgma", "nj"])
def test_trees_hold_no_pairs(spark, monkeypatch, method):
    counts = held_rows(monkeypatch, tree)
    _, alignment = with_copies(spark)
    got = tree.array_trees(alignment, method=method)
    assert got.where("parent_id is null").count() == 3 and counts and max(counts) <= 19


def test_pairs_are_neither_held_nor_shuffled(spark, monkeypatch):
    counts = held_rows(monkeypatch, tree)
    rows, alignment = with_copies(spark)
    want = {tuple(x) for x in tree.group_distances(alignment).collect()}
    monkeypatch.setattr(tree, "BLOCK", 4)
    monkeypatch.setattr(tree, "PAIRS", 5)
    pairs = tree.group_distances(alignment)
    above = pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "Exchange" not in above and "Join" not in above
    got = pairs.collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) == 30 * 29 // 2 + 9 * 8 // 2 + 1
    assert max(counts) <= 19


def test_metrics_of_a_deep_tree(spark, monkeypatch):
    """A chain with a leaf at each node: no table has a row for each node and each of those above it."""
    counts = held_rows(monkeypatch, tree)
    rows = [("g", f"n{k}", f"n{k - 1}" if k else None, 1.0) for k in range(200)] + [("g", f"x{k}", f"n{k}", 200.0 - k) for k in range(200)]
    deep = spark.createDataFrame(rows, "group_id string, node_id string, parent_id string, branch_length double")
    m = tree.metrics(deep.withColumn("depth", F.lit(0))).first()
    assert (m.height, m.n_leaves, m.ultrametric) == (200.0, 200, True) and max(counts) <= 400


def test_refinement_asks_for_ancestors_and_order_once(spark, data, monkeypatch):
    from stemma.plans import model_queries

    asked = []
    for module, name in ((tree, "ancestors"), (reconstruct, "ancestors"), (arrays, "closure")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: asked.append(n) or f(*a, **k))
    assert model_queries.refinement_keeps_leaves(spark, data).count() == 5
    assert sorted(asked) == ["ancestors", "closure"]


def test_held_tables_leave_no_mark(spark):
    """The driver starts a process for each file that it makes, and its memory counts twice until that runs."""
    from urllib.parse import urlsplit

    from stemma.tables import held

    out = held(spark.range(10))
    folder = urlsplit(out.inputFiles()[0]).path.rpartition("/")[0]
    assert out.count() == 10 and not os.path.exists(f"{folder}/_SUCCESS")


def test_distance_queries_take_whole_groups(spark, data):
    from stemma import views
    from stemma.plans import table_queries

    sizes = {x.group_id: x.n for x in views.event_arrays(spark, data).groupBy("group_id").agg(F.countDistinct("array_id").alias("n")).collect()}
    assert {x.group_id: x["count"] for x in table_queries.pair_distances(spark, data).groupBy("group_id").count().collect()} == {g: n * (n - 1) // 2 for g, n in sizes.items()}
    for query in (table_queries.upgma_trees, table_queries.neighbour_joining_trees):
        nodes = [(x.group_id, x.node_id, x.parent_id) for x in query(spark, data).collect()]
        inner = {(g, p) for g, _, p in nodes}
        assert {g: sum((g, n) not in inner for h, n, _ in nodes if h == g) for g in sizes} == sizes


def test_alignment(spark):
    held = {"A": "321", "B": "4217", "C": "6527", "D": "3217"}
    got = align.align_groups(long(spark, held)).collect()
    for name, tokens in held.items():
        assert "".join(r.token for r in sorted(got, key=lambda r: r.col) if r.array_id == name) == tokens
    assert all(len({r.token for r in got if r.col == c}) == 1 for c in {r.col for r in got})
    bad = aligned(spark, {"A": "1 2", "B": "1 3", "C": "4 3"})
    fixed = align.split_columns(bad).collect()
    assert all(len({r.token for r in fixed if r.col == c}) == 1 for c in {r.col for r in fixed})
    apart = aligned(spark, {"A": "1 2 -", "B": "- - 2"})
    assert align.join_duplicates(apart).select("col").where("token = '2'").distinct().count() == 1
    assert align.join_duplicates(aligned(spark, {"A": "2 1 2"})).count() == 3
    assert {r.token for r in align.renamed_duplicates(aligned(spark, {"A": "2 1 2"})).collect()} == {"2A", "1", "2B"}
    younger = {1: {6, 5, 4, 3, 2}, 2: {6, 5, 4, 3}, 3: {6, 5, 4}, 4: {6, 5}, 5: {6}}
    assert sorted(map(len, align.partial_loss_sets([5, 4, 2], [6, 3, 1], younger))) == [1, 2]


def test_simulation(spark):
    p = simulate.grid(spark, n_leaves=[8], gain=[5.0], loss=[0.5], alpha=[1.0, 2.0], model=["block", "independent", "fragment"])
    nodes, events = simulate.simulate(p).collect(), simulate.simulated_events(p).collect()
    assert simulate.simulate(p).collect() == nodes
    held = {(r.sim_id, r.node_id): r for r in nodes}
    for (s, n), r in held.items():
        if r.parent_id is not None:
            now = set(held[s, r.parent_id].tokens)
            for e in sorted((e for e in events if (e.sim_id, e.node_id) == (s, n)), key=lambda e: e.time):
                now = now | set(e.tokens) if e.kind == "gain" else now - set(e.tokens)
            assert now == set(r.tokens)
    assert sum(r.is_leaf for r in nodes) == 8 * 6
    t = spark.createDataFrame([([1, 2, 3, 4],)], "t array<int>")
    two = lambda kind, c=None: t.select(simulate.mutated(F.col("t"), kind, F.lit(1), F.lit(3), c)).first()[0]
    assert two("duplicate") == [1, 2, 3, 2, 3, 4] and two("reverse") == [1, 3, 2, 4] and two("move", F.lit(0)) == [2, 3, 1, 4] and two("copy", F.lit(4)) == [1, 2, 3, 4, 2, 3]


def test_orientation_and_analysis(spark):
    f = spark.createDataFrame([("a", -10.0, "f"), ("b", -30.0, "f"), ("c", -10.0, "f")], "group_id string, lnl_bdm double, run string")
    b = spark.createDataFrame([("a", -30.0, "b"), ("b", -10.0, "b")], "group_id string, lnl_bdm double, run string")
    got = {r.group_id: (r.recommendation, r.run) for r in orient.compare(f, b).collect()}
    assert got == {"a": ("forward", "f"), "b": ("reverse", "b"), "c": ("nd", "f")}
    rows = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert analysis.below_quantile(rows, "x", 0.95).count() == 95
    assert spark.range(1).select(decision(F.lit(6.0))).first()[0] == "forward"


def test_filters(spark):
    rows = spark.createDataFrame([("a", 4, 100, 200, [(250, 30)], [None]), ("b", 3, None, 5, [], ["IE"]), ("c", 4, 1, 2, [(90_000, 5)], [None])], "array_id string, evidence_level int, array_start int, array_end int, genes array<struct<start:int,length:int>>, types array<string>")
    assert [r.array_id for r in filters.by_evidence(rows).collect()] == ["a", "c"]
    far = filters.with_gene_distance(rows)
    assert [r.distance for r in far.collect()] == [50, None, 89_998]
    assert [r.array_id for r in filters.near_genes_or_typed(far).collect()] == ["a", "b"]
    names = spark.createDataFrame([("a",)], "array_id string")
    assert filters.without_arrays(rows, names).count() == 2 and filters.only_arrays(rows, names).count() == 1
    blocks = spark.createDataFrame([("g", "n", 1, 5), ("g", "n", 1, 6), ("g", "n", 2, 7)], "group_id string, node_id string, block int, token int")
    old = spark.createDataFrame([("g", 5)], "group_id string, token int")
    assert filters.blocks_with(blocks, old).count() == 2 and filters.blocks_with(blocks, old, all_of_them=True).count() == 0


def test_death_process(spark):
    rho, alpha, t, n = 0.7, 1.8, 0.9, 25
    p, steps = [1.0] + [0.0] * n, 4000
    g = 1 - 1 / alpha

    def slope(p):
        return [0.0] + [rho / alpha * sum(g ** (i - k - 1) * (k + 1) * p[k] for k in range(i)) - i * rho * p[i] for i in range(1, n + 1)]

    h = t / steps
    for _ in range(steps):
        a = slope(p)
        b = slope([x + h / 2 * y for x, y in zip(p, a, strict=True)])
        p = [x + h * y for x, y in zip(p, b, strict=True)]
    got = fit.death_likelihoods(rho, alpha, t, n)
    assert all(math.isclose(x, y, rel_tol=1e-4) for x, y in zip(got, p, strict=True)) and len(fit.death_likelihoods(rho, alpha, t, 68)) == 69
    assert math.isclose(got[1], (1 - math.exp(-rho * t)) / alpha)
    rows = spark.createDataFrame([("g", 1.0, 6, [1, 3]), ("g", 0.5, 4, []), ("h", 1.0, 3, [])], "k string, t double, kept long, sizes array<int>")
    r = {x.k: x for x in fit.fit_precise(rows, "k").collect()}
    assert r["h"].lnl == 0 and r["g"].rho > 0 and r["g"].alpha >= 1
    best = fit.precise_log_likelihood(r["g"].rho, r["g"].alpha, [(1.0, 6, [1, 3]), (0.5, 4, [])])
    assert all(best >= fit.precise_log_likelihood(r["g"].rho * f, max(1.0, r["g"].alpha * e), [(1.0, 6, [1, 3]), (0.5, 4, [])]) - 1e-3 for f in (0.9, 1.1) for e in (0.9, 1.1))


def test_leaves_with_several_arrays(spark):
    t = spark.createDataFrame([("g", "r", None, 0.0), ("g", "a", "r", 1.0), ("g", "b", "r", 1.0), ("g", "c", "r", 1.0)], "group_id string, node_id string, parent_id string, branch_length double")
    actions = spark.createDataFrame([("g", "a", 2, "split"), ("g", "b", 2, "prune"), ("g", "c", 1, "keep")], "group_id string, node_id string, n long, action string")
    got = {(r.node_id, r.parent_id) for r in tree.with_leaf_actions(t, actions).collect()}
    assert got == {("r", None), ("a", "r"), ("a_1", "a"), ("a_2", "a"), ("c", "r")}


def test_simulation_run(spark):
    p = simulate.grid(spark, n_leaves=[5], gain=[0.0, 4.0], loss=[0.5], alpha=[2.0], model=["block", "independent"])
    out = simulate.run(p, turn=True)
    rows = {r.sim_id: r for r in out["protocol"].collect()}
    assert len(rows) == 2 and {r.skip_reason for r in out["skipped"].collect()} == {"gain or loss rate is 0"}
    nodes, events = simulate.simulate(p.where("gain > 0")).collect(), simulate.simulated_events(p.where("gain > 0")).collect()
    for k, r in rows.items():
        arrays = {n.node_id: n for n in nodes if n.sim_id == k}
        leaves = {t for n in arrays.values() if n.is_leaf for t in n.tokens}
        ever = {t for n in arrays.values() for t in n.tokens} | {t for e in events if e.sim_id == k and e.kind == "gain" for t in e.tokens}
        assert r.n_tokens == len(ever) and r.never_seen == sorted(ever - leaves) and r.leaf_lengths == {n: len(x.tokens) for n, x in arrays.items() if x.is_leaf}
        by_event = sorted(1.0 if e.before == 1 else i / (e.before - 1) for e in events if e.sim_id == k and e.kind == "loss" for i in e.places)
        up = [(arrays[n.parent_id].tokens, n.tokens) for n in arrays.values() if n.parent_id]
        by_branch = sorted(1.0 if len(a) == 1 else i / (len(a) - 1) for a, b in up for i, t in enumerate(a) if t not in b)
        assert [r.event_loss_positions, r.branch_loss_positions] == [pytest.approx(by_event), pytest.approx(by_branch)]
    whole: dict = {}
    for r in out["arrays"].orderBy("pos").collect():
        whole.setdefault((r.group_id, r.array_id), []).append(r.token)
    assert all(whole[n.sim_id, n.node_id] == (n.tokens[::-1] if rows[n.sim_id].orientation == 2 else n.tokens) for n in nodes if n.is_leaf and n.tokens)


def test_simulations_as_reconstructions(spark):
    """The true arrays as states: their branch events are what simulated events leave at the branches' ends."""
    p = simulate.grid(spark, n_leaves=[6], gain=[5.0], loss=[0.5], alpha=[2.0], model=["block"])
    nodes = simulate.simulate(p)
    t = nodes.select(F.col("sim_id").alias("group_id"), "node_id", "parent_id", "branch_length")
    got = {(r.node_id, r.token, r.kind) for r in reconstruct.branch_events(simulate.as_states(nodes), t).collect()}
    held = {n.node_id: n for n in nodes.collect()}
    want = set()
    for n in held.values():
        before = set(held[n.parent_id].tokens) if n.parent_id else set()
        want |= {(n.node_id, x, "gain") for x in set(n.tokens) - before} | {(n.node_id, x, "loss") for x in before - set(n.tokens)}
    assert got == want
