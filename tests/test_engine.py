import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stemma import engine, views
from stemma.operators import reconstruct, simulate, tree
from stemma.sources import readers
from stemma.streaming import incremental


def test_run_on_simulated_groups(spark):
    p = simulate.grid(spark, n_leaves=[6], gain=[6.0], loss=[0.6], alpha=[2.0], model=["block"]).select("sim_id", "n_leaves", "gain", "loss", "alpha", "model")
    nodes = simulate.simulate(simulate.repeated(p, 2).withColumn("sim_id", F.col("run").cast("long")).drop("run")).withColumn("group_id", F.concat(F.lit("g"), "sim_id")).cache()
    held = nodes.where("is_leaf").select("group_id", F.col("node_id").alias("array_id"), F.posexplode("tokens").alias("pos", "token")).withColumn("token", F.col("token").cast("string"))
    alone = spark.createDataFrame([("lonely", "x", 0, "1")], "group_id string, array_id string, pos int, token string")
    out = engine.run(held.unionByName(alone), readers.Settings(determine_orientation=True), nodes.select("group_id", "node_id", "parent_id", "branch_length"))
    rows = {r.group_id: r for r in out["protocol"].collect()}
    assert rows["lonely"].status == "skipped" and rows["lonely"].skip_reason == "minimum_array_number"
    for g in ("g0", "g1"):
        r = rows[g]
        assert r.status in ("main", "trivial") and math.isfinite(r.lnl_forward) and r.recommendation in ("forward", "reverse", "nd") and r.alpha >= 1
    assert not out["events"].isEmpty() and {r.group_id for r in out["trees"].select("group_id").distinct().collect()} == {"g0", "g1"}


def test_run_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "G1.fa").write_text(">A\n5, 4, 3, 2, 1\n>B\n6, 3, 2, 1\n>C\n7, 5, 4, 3, 1\n>D\n5, 4, 3, 2, 1\n")
    (tmp_path / "in" / "G2.fa").write_text(">A\n1e, 2, 1e\n>B\n3, 2, 1e\n")
    (tmp_path / "in" / "G3.fa").write_text(">A\n1\n")
    engine.main([str(tmp_path / "in"), str(tmp_path / "out"), "--combine_non_unique_arrays"])
    got = {r.group_id: r.status for r in spark.read.parquet(str(tmp_path / "out" / "protocol")).collect()}
    assert got["G3"] == "skipped" and got["G1"] in ("main", "trivial") and set(got) == {"G1", "G2", "G3"}
    assert spark.read.json(str(tmp_path / "out" / "trees")).count() == 2 and spark.read.text(str(tmp_path / "out" / "summary")).count() == 2


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{data}/even*.parquet")
    for name, f in (("seen", incremental.first_seen), ("counts", incremental.token_counts)):
        q = f(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination(120)
    seen = spark.read.parquet(str(tmp_path / "seen"))
    assert seen.count() == seen.select("group_id", "array_id", "token").distinct().count() == views.event_arrays(spark, data).count()


def test_unknown_arguments_are_errors():
    engine.options(readers.Settings.from_lines(["in", "out", "--lh_fct", "ode_based", "--extend_branches", "0.5"]))
    for bad in (["in", "out", "--unheard_of", "3"], ["in", "out", "--lh_fct", "other"], ["in", "out", "--input_type", "pickled"]):
        with pytest.raises(ValueError):
            engine.options(readers.Settings.from_lines(bad))


def test_run_from_finder_results(spark, tmp_path):
    """One repeat in both readings, spacers an edit apart, two groups that share no spacer."""
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    repeat, pool = "AACCGGTTAC", {k: "".join(random.Random(k).choices("ACGT", k=20)) for k in range(12)}
    near = pool[2][:10] + ("A" if pool[2][10] != "A" else "C") + pool[2][11:]
    held = {"x": [5, 4, 3, 2, 1], "y": [4, 2, 1], "z": [6, 3, 2], "u": [11, 10, 9], "v": [10, 9]}
    for n, (name, tokens) in enumerate(held.items()):
        spacers = [near if name == "y" and k == 2 else pool[k] for k in tokens]
        minus = n % 2 == 1
        spacers = [rc(s) for s in spacers[::-1]] if minus else spacers
        regions = [{"Type": "Spacer", "Sequence": s} for s in spacers] + [{"Type": "DR", "Sequence": repeat}]
        array = {"Name": "a", "Start": 1, "End": 9, "Evidence_Level": 4, "DR_Consensus": rc(repeat) if minus else repeat, "CRISPRDirection": "-" if minus else "+", "Potential_Orientation": "ND", "Regions": regions}
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "result.json").write_text(json.dumps({"Sequences": [{"Id": name, "Length": 99, "Crisprs": [array]}]}))
    engine.main([str(tmp_path / "in"), str(tmp_path / "out"), "--input_type", "ccf_json", "--cluster_spacers", "--verbosity", "0"])
    got = spark.read.parquet(str(tmp_path / "out" / "protocol"))
    rows = {r.group_id: r for r in got.collect()}
    assert {g.split("_")[-1] for g in rows} == {repeat} and sorted(r.n_arrays for r in rows.values()) == [2, 3]
    assert sorted(r.n_unique_tokens for r in rows.values()) == [3, 6]  # the near spacer is the other's
    assert sorted(map(sorted, (r.arrays for r in rows.values()))) == [["u_a", "v_a"], ["x_a", "y_a", "z_a"]]
    assert spark.read.json(str(tmp_path / "out" / "clusters")).count() == 1


def test_run_with_duplicate_tokens(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for g in ("G1", "G2", "G3"):
        (tmp_path / "in" / f"{g}.fa").write_text(">A\n5, 4, 2, 3, 2, 1\n>B\n5, 4, 3, 2, 1\n>C\n6, 4, 3, 1\n>D\n7, 2, 3, 2, 1\n>E\n3, 1\n")
    out = str(tmp_path / "out")
    engine.main([str(tmp_path / "in"), out, "--group_by", "2", "--lh_fct", "ode_based", "--save_reconstructed_events", "--alternative_parameter_estimation", "--partial_order_blocks", "--extend_branches", "0.1", "--verbosity", "0"])
    rows = spark.read.parquet(f"{out}/protocol").collect()
    about = lambda v: f"{v:.6g}" if isinstance(v, float) else [about(x) for x in v] if isinstance(v, (list, tuple)) else v
    assert len(rows) == 3 and len({str([about(r[c]) for c in r.asDict() if c not in ("group_id", "run_time", "tree")]) for r in rows}) == 1  # equal groups, equal rows
    r = rows[0]
    assert r.n_tokens == 8 and r.n_unique_tokens == 7 and r.n_duplicate_candidates == 1
    assert r.n_rearrangements + r.n_duplications + r.n_reacquisitions + r.n_independent_gains + r.n_other_duplicate_events == 1
    assert r.n_insertions == r.n_tokens + r.n_repeated_gains and len(r.loss_blocks) == r.m and sum(r.loss_blocks) == r.lost and len(r.relative_loss_positions) == r.n_losses == r.lost
    assert r.rho_bdm_unbiased == r.rho_bdm + r.rho_shift and math.isfinite(r.rho_precise) and r.min_length >= 0.1 and r.run_time > 0
    assert {"containing_old_alpha", "excluding_young_alpha", "fs_presence", "global_les_presence", "leaf_lengths"} <= set(r.asDict())
    events = json.loads(json.dumps(spark.read.json(f"{out}/reconstructed_events").first().asDict()))
    assert all(k in events for k in ("profiles", "gains", "losses", "order", "duplicates", "tree"))
    csv = lambda name: spark.read.option("header", True).csv(f"{out}/{name}")
    assert csv("overall").count() == 1 and csv("pooled").count() == 1 and "loss_blocks" not in csv("0_results").columns
    assert spark.read.json(f"{out}/token_numbers").count() == 3


def test_leaves_without_arrays_are_pruned(spark):
    t = spark.createDataFrame([("g", "r", None, 0.0), ("g", "i", "r", 1.0), ("g", "a", "i", 1.0), ("g", "x", "i", 1.0), ("g", "j", "r", 1.0), ("g", "y", "j", 1.0)], "group_id string, node_id string, parent_id string, branch_length double")
    kept = spark.createDataFrame([("g", "a")], "group_id string, node_id string")
    assert {r.node_id for r in tree.pruned(t, kept).collect()} == {"r", "i", "a"}


def test_orders_of_a_deep_tree(spark):
    """A caterpillar of 150 levels: depths by doubling, orders in one pass, and the best states of all."""
    nodes = [("g", "n000", None, 0.0)] + [("g", f"n{k:03}", f"n{k - 1:03}", 0.1) for k in range(1, 151)] + [("g", f"t{k:03}", f"n{k:03}", 0.2) for k in range(151)]
    t = spark.createDataFrame(nodes, "group_id string, node_id string, parent_id string, branch_length double")
    deep = {r.node_id: r.depth for r in tree.with_depth(t).collect()}
    assert deep["n000"] == 0 and deep["n150"] == 150 and deep["t150"] == 151 and len(deep) == len(nodes)
    orders = {r.node_id: r for r in tree.with_orders(t).collect()}
    assert all(orders[n].depth == d for n, d in deep.items()) and orders["n000"].post_ord == len(nodes) - 1 and orders["n000"].pre_ord == 0
    profile = spark.createDataFrame([("g", f"t{k:03}", tok, int(k >= tok)) for k in range(151) for tok in (0, 75, 150)], "group_id string, node_id string, token long, present int")
    states = {(r.node_id, r.token): r.state for r in reconstruct.joint_states(profile, tree.with_depth(t), 0.01, 0.01).collect()}
    assert len(states) == 3 * len(nodes) and all(states[f"n{k:03}", 75] == int(k >= 75) for k in range(151) if k != 75) and all(states[f"n{k:03}", 0] for k in range(151))


def test_run_without_usable_groups(spark):
    held = spark.createDataFrame([("g", "a", 0, "1"), ("h", "b", 0, "2")], "group_id string, array_id string, pos int, token string")
    for rows in (held, held.limit(0)):
        out = engine.run(rows, readers.Settings(determine_orientation=True, group_by=2))
        got = out["protocol"].collect()
        assert len(got) == rows.count() and all(r.status == "skipped" and r.skip_reason == "minimum_array_number" for r in got)
        assert out["events"].isEmpty() and out["overall"].isEmpty() and out["pooled"].isEmpty()


def test_named_lists_and_excluded_groups(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for g in ("G1", "G2"):
        (tmp_path / "in" / f"{g}.txt").write_text("('x', 'y')\n\nA: 4, 3, 2, 1\nB: 5, 3, 1\nC: 3, 2, 1\n")
    engine.main([str(tmp_path / "in"), str(tmp_path / "out"), "--input_type", "named_lists", "--exclude_groups", "G2", "--verbosity", "0"])
    assert [r.group_id for r in spark.read.parquet(str(tmp_path / "out" / "protocol")).collect()] == ["G1"]
