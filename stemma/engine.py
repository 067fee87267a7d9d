"""The whole run: arrays in, a protocol row for each group out, with events, trees and orientations.

    python -m stemma <arrays folder> <output folder> [--tree_path trees.json] [--determine_orientation] ...
"""

from __future__ import annotations

import logging
import sys
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma import sinks
from stemma.functions.scalar import GUIDE_GAIN, GUIDE_LOSS, SIMPLE_DISTANCE, chi2_quantile, unbiased_alpha
from stemma.operators import align, arrays, cluster, filters, fit, orient, reconstruct, tree
from stemma.operators.arrays import _held
from stemma.sources import readers

log = logging.getLogger("stemma")

#: Arguments that `Settings.more` may have, with their defaults; others are errors.
MORE = {
    "tree_path": None, "cluster_spacers": False, "cluster_spacers_max_distance": None, "insertion_rate": GUIDE_GAIN, "deletion_rate": GUIDE_LOSS, "extend_branches": 0.0,
    "tree_insertion_rate": SIMPLE_DISTANCE["gain"], "tree_deletion_rate": SIMPLE_DISTANCE["loss"], "tree_alpha": SIMPLE_DISTANCE["alpha"],
    "lh_fct": "simple", "no_alpha_bias_correction": False, "no_rho_bias_correction": False, "alternative_parameter_estimation": False, "partial_order_blocks": False,
    "save_reconstructed_events": False, "exclude_groups": None, "rec_model": "gtr", "tree_distance_function": "likelihood", "verbosity": 1,
}
CHOICES = {"input_type": {"spacer_fasta", "sf", "ccdb", "ccf_json", "named_lists"}, "lh_fct": {"simple", "ode_based"}, "tree_construction_method": {"upgma", "nj"}, "rec_model": {"gtr"}, "tree_distance_function": {"likelihood"}, "distance_function": {"likelihood"}}
CLASSES = {"rearrangement": "n_rearrangements", "duplication": "n_duplications", "reacquisition": "n_reacquisitions", "independent acquisition": "n_independent_gains", "other": "n_other_duplicate_events"}


@dataclass
class Run:
    """What one reading direction gives."""

    alignment: DataFrame
    rank: DataFrame
    trees: DataFrame
    states: DataFrame
    events: DataFrame
    forced: DataFrame
    statistics: DataFrame
    duplicates: DataFrame
    protocol: DataFrame


def options(settings: readers.Settings) -> dict:
    """All further arguments of a run; unknown names and values are errors."""
    if unknown := sorted(set(settings.more) - set(MORE)):
        raise ValueError(f"unknown arguments: {', '.join(unknown)}")
    out = dict(MORE)
    for name, v in settings.more.items():
        kind = type(MORE[name])
        out[name] = v if MORE[name] is None or not isinstance(v, str) else v.lower() in ("true", "1") if kind is bool else kind(v)
    for name, allowed in CHOICES.items():
        if (v := out.get(name, getattr(settings, name, None))) not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(sorted(allowed))}, not {v}")
    return out


def aligned(held: DataFrame) -> DataFrame:
    """Alignment with unique tokens: group_id, array_id, col, base, token."""
    return _held(align.renamed_duplicates(align.join_duplicates(align.align_groups(held))))


def mirrored(alignment: DataFrame) -> DataFrame:
    last = F.max("col").over(Window.partitionBy("group_id"))
    return alignment.withColumn("last", last).withColumn("col", F.col("last") - F.col("col")).drop("last")


def estimated_trees(alignment: DataFrame, method: str, more: dict | None = None) -> DataFrame:
    """A tree for each group from its arrays' distances; a group's arrays are bounded, so its pairs are."""
    more = more or MORE
    rates = (more["tree_insertion_rate"], more["tree_deletion_rate"], more["tree_alpha"])
    return tree.array_trees(alignment.select("group_id", "array_id", "col", "token"), *rates, method)


def with_rates(trees: DataFrame, alignment: DataFrame, gain: float, loss: float) -> DataFrame:
    """Trees with their orders and the guide's rates: loss over the height, gain over columns times height."""
    deep = _held(tree.with_orders(trees))
    height = tree.metrics(deep).select("group_id", "height")
    columns = alignment.groupBy("group_id").agg(F.countDistinct("col").alias("columns"))
    rates = height.join(columns, "group_id").select("group_id", (F.lit(gain) / (F.col("columns") * F.col("height"))).alias("gain"), (F.lit(loss) / F.col("height")).alias("loss"))
    return _held(deep.join(rates, "group_id"))


def _listed(rows: DataFrame, name: str, *fields: str | Column) -> DataFrame:
    """group_id and a list of the rows' fields, in their order."""
    one = F.struct(*fields) if len(fields) > 1 else F.col(fields[0]) if isinstance(fields[0], str) else fields[0]
    return rows.groupBy("group_id").agg(F.sort_array(F.collect_list(one)).alias(name))


def _details(states: DataFrame, rated: DataFrame, rank: DataFrame, blocks: DataFrame, alignment: DataFrame) -> list[DataFrame]:
    """The protocol's lists: block lengths, places of losses, presence from the ends, lengths, names, tree, order."""
    here = states.where(F.col("state") == 1)
    parents = here.groupBy("group_id", F.col("node_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("n")).join(rated.select("group_id", "node_id", "parent_id"), ["group_id", "parent_id"])
    sized = blocks.join(parents, ["group_id", "node_id"])
    leaves = alignment.groupBy("group_id", "array_id").agg(F.count(F.lit(1)).alias("n"))
    out = [
        _listed(blocks, "loss_blocks", "size"), _listed(sized.withColumn("share", F.col("size") / F.col("n")), "loss_blocks_normalised", "share"),
        _listed(reconstruct.loss_positions(states, rated, rank), "relative_loss_positions", "position"), _listed(parents, "kept_tokens", "n"),
        leaves.groupBy("group_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("array_id", "n")))).alias("leaf_lengths"), F.sort_array(F.collect_list("array_id")).alias("arrays")),
        _listed(rated.where(F.col("parent_id").isNotNull()), "branch_lengths", "branch_length"), _listed(rank, "topological_order", "rank", "token"),
        sinks.newick(rated.select("group_id", "node_id", "parent_id", "branch_length")).withColumnRenamed("newick", "tree"),
    ]
    for anchor, name in (("first", "fs_presence"), ("last", "ls_presence"), ("first_kept", "fes_presence"), ("last_kept", "les_presence")):
        out.append(_listed(reconstruct.offsets(states, rated, rank, anchor), name, "m", "present", "total"))
    for end in ("first", "last"):
        out.append(_listed(reconstruct.global_offsets(states, rated, rank, end), f"global_{'fes' if end == 'first' else 'les'}_presence", "m", "present", "total"))
    return out


def _alternative(states: DataFrame, rated: DataFrame, events: DataFrame, tokens: DataFrame) -> list[DataFrame]:
    """Both models fitted to the blocks that hold an old token, and to those of old tokens only."""
    old, out = filters.old_tokens_by_group(events, rated), []
    for kind, all_of_them in (("containing_old", False), ("excluding_young", True)):
        blocks = reconstruct.block_sizes(filters.blocks_with(tokens, old, all_of_them))
        got = fit.fit(fit.branch_statistics(states, blocks, rated).withColumn("t", F.col("t").cast("double")), "group_id")
        out.append(got.select("group_id", *(F.col(c).alias(f"{kind}_{c}") for c in ("rho_idm", "rho_bdm", "alpha"))))
    return out


def one_direction(alignment: DataFrame, trees: DataFrame, settings: readers.Settings, gain: float | None = None, loss: float | None = None) -> Run:
    began, more = time.time(), options(settings)
    columns = alignment.select("group_id", "base", "token", "col").distinct()
    width = F.max("col").over(Window.partitionBy("group_id"))
    named = _held(columns.withColumn("width", width).select("group_id", F.col("base").cast("string").alias("base"), "token", (F.col("width") - F.col("col") + 1).alias("rank")))
    rank = named.select("group_id", "token", "rank")
    order = arrays.closure(arrays.edges(alignment.select("group_id", "array_id", F.col("col").alias("pos"), "token")))
    if more["extend_branches"]:
        trees = tree.extended(trees, float(more["extend_branches"]))
    rated = with_rates(trees, alignment, more["insertion_rate"] if gain is None else gain, more["deletion_rate"] if loss is None else loss)
    profile = _held(arrays.presence(alignment, rank).select("group_id", F.col("array_id").alias("node_id"), "token", "present"))
    # The guide: its gains tell which copies may have come by duplication; these don't take part in the order.
    guide = _held(reconstruct.branch_events(_held(reconstruct.joint_states(profile, rated, "gain", "loss")), rated))
    guide_gains = guide.where(F.col("kind") == "gain").join(named.select("group_id", "token", "base"), ["group_id", "token"]).join(rated.select("group_id", "node_id", "post_ord", "depth"), ["group_id", "node_id"])
    candidates = _held(reconstruct.duplicate_candidates(guide_gains.select("group_id", "node_id", "base", "token", "post_ord")).select("group_id", "node_id", "base", "token"))
    order = _held(reconstruct.without_tokens(order, candidates))
    guide_contradictions = reconstruct.contradictions(guide, rated, order)
    states, forced = reconstruct.refined_states(profile, rated, order, "gain", "loss")
    events = _held(reconstruct.branch_events(states, rated))
    tokens = _held(reconstruct.partial_loss_blocks(states, rated, order) if more["partial_order_blocks"] else reconstruct.loss_block_tokens(states, rated, rank))
    blocks = _held(reconstruct.block_sizes(tokens))
    stats = _held(fit.branch_statistics(states, blocks, rated).withColumn("t", F.col("t").cast("double")))
    fits = fit.fit(stats, "group_id")
    pooled = fit.pooled_statistics(stats, "group_id")
    inner = events.join(rated.select("group_id", "node_id", "parent_id", "depth"), ["group_id", "node_id"])
    counts = inner.groupBy("group_id").agg(F.count_if((F.col("kind") == "gain") & F.col("parent_id").isNotNull()).alias("n_gains"), F.count_if(F.col("kind") == "loss").alias("n_losses"), F.count_if(F.col("kind") == "gain").alias("n_insertions"))
    duplicates = _held(reconstruct.duplicate_classes(reconstruct.duplicate_flags(candidates, states, events, rated, order, named)))
    of_class = duplicates.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_duplicate_candidates"), *(F.count_if(F.col("kind") == k).alias(n) for k, n in CLASSES.items()))
    moved = reconstruct.moved_tokens(inner.where(F.col("kind") == "gain").select("group_id", "node_id", "token", "depth"), guide_gains).withColumnRenamed("n", "n_moved")
    zero_counts = [
        counts, of_class, moved, reconstruct.repeated_gains(events).select("group_id", F.col("repeated").alias("n_repeated_gains")), guide_gains.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_guide_gains")),
        guide_contradictions.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_guide_contradictions")), forced.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_refined")),
    ]
    facts = alignment.groupBy("group_id").agg(F.countDistinct("array_id").alias("n_arrays"), F.countDistinct("token").alias("n_tokens"), F.countDistinct("base").alias("n_unique_tokens"), (F.count(F.lit(1)) / F.countDistinct("array_id")).alias("mean_length"))
    p = facts.join(tree.metrics(rated), "group_id").join(pooled, "group_id").join(fits, "group_id")
    for x in zero_counts:
        p = p.join(x, "group_id", "left").na.fill(0, [c for c in x.columns if c != "group_id"])
    p = _held(p)
    for x in [*_details(states, rated, rank, blocks, alignment), *(_alternative(states, rated, events, tokens) if more["alternative_parameter_estimation"] else [])]:
        p = p.join(x, "group_id", "left")
    if not more["no_rho_bias_correction"]:
        gains = events.where(F.col("kind") == "gain").groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("gains"))
        shift = fit.corrected(stats, rated.select("group_id", "node_id", "parent_id", "branch_length"), gains).select("group_id", F.col("shift").alias("rho_shift"))
        p = p.join(shift, "group_id", "left").withColumns({f"{c}_unbiased": F.col(c) + F.col("rho_shift") for c in ("rho_idm", "rho_bdm")})
    if more["lh_fct"] == "ode_based":
        sizes = stats.join(blocks.groupBy("group_id", "node_id").agg(F.collect_list("size").alias("sizes")), ["group_id", "node_id"], "left")
        precise = fit.fit_precise(sizes.select("group_id", "t", "kept", F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes")), "group_id")
        p = p.join(precise.select("group_id", F.col("rho").alias("rho_precise"), F.col("alpha").alias("alpha_precise"), F.col("lnl").alias("lnl_precise")), "group_id", "left")
    level = settings.significance_level
    p = p.withColumn("model", F.when(F.col("lrt") > chi2_quantile(level), "BDM").otherwise("IDM")).withColumns({"significance_level": F.lit(level), "chi2_quantile": F.lit(chi2_quantile(level))})
    if not more["no_alpha_bias_correction"]:
        p = p.withColumn("alpha_unbiased", F.when(F.col("m") > 0, unbiased_alpha(F.col("alpha"), F.col("m"))))
    rates = fit.derived_rates(F.col("rho_bdm"), F.col("alpha"), F.col("mean_length"))
    p = p.withColumns({"loss_rate_per_token": rates["per_token"], "insertion_rate": rates["insertion"], "insertion_rate_idm": F.col("rho_idm") * F.col("mean_length")})
    p = _held(p.withColumn("status", F.when(F.col("m") > 0, "main").otherwise("trivial")))
    log.info("one direction took %.1f s", time.time() - began)
    return Run(alignment, rank, rated, states, events, forced, stats, duplicates, _held(p.withColumn("run_time", F.lit(time.time() - began))))


def pooled_estimates(run: Run, group_by: str | int | None, significance: float) -> dict[str, DataFrame]:
    """overall: one fit over all groups' branches; pooled: one for each pool, of so many groups or of a column's value."""
    tested = lambda f: f.withColumn("model", F.when(F.col("lrt") > chi2_quantile(significance), "BDM").otherwise("IDM"))
    main = run.statistics.join(run.protocol.where(F.col("status") == "main").select("group_id"), "group_id", "left_semi")
    out = {"overall": tested(fit.fit(run.statistics.withColumn("pool", F.lit("all")), "pool"))}
    if group_by is not None:
        groups = run.protocol.where(F.col("status") == "main")
        number = str(group_by).isdigit()
        pools = fit.chunked(groups.select("group_id"), int(group_by)) if number else groups.select("group_id", F.col(str(group_by)).cast("string").alias("pool"))
        out["pooled"] = tested(fit.fit(main.join(pools, "group_id"), "pool"))
    return out


def run(held: DataFrame, settings: readers.Settings | None = None, trees: DataFrame | None = None) -> dict[str, DataFrame]:
    """protocol, events, trees and, where asked for, orientations. held: group_id, array_id, pos, token.

    trees: group_id, node_id, parent_id, branch_length with leaves named as arrays; groups without one are skipped, and
    leaves without an array are pruned.
    """
    settings = settings or readers.Settings()
    more = options(settings)
    held = held.withColumn("array_id", F.col("array_id").cast("string"))
    before = held.groupBy("group_id").agg(F.countDistinct("array_id").alias("n_arrays_before"))
    names = None
    if settings.combine_non_unique_arrays:
        found = _held(arrays.dedup(held))
        held = held.join(found.select("group_id", F.col("representative").alias("array_id")), ["group_id", "array_id"])
        names = found.where(F.col("n") > 1).groupBy("group_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("representative", "members")))).alias("combined_arrays"))
    checked = _held(arrays.group_selection(held, [("minimum_array_number", settings.min_arrays), ("empty_arrays", None)]))
    if trees is not None:
        missing = checked.join(trees.select("group_id").distinct(), "group_id", "left_anti").select("group_id").withColumn("gone", F.lit(True))
        checked = _held(checked.join(missing, "group_id", "left").select("group_id", "n_arrays", "n_unique", F.coalesce("skip_reason", F.when(F.col("gone"), "no tree")).alias("skip_reason")))
        held = held.join(trees.select("group_id", F.col("node_id").alias("array_id")), ["group_id", "array_id"], "left_semi")
        trees = _held(tree.pruned(trees, held.select("group_id", F.col("array_id").alias("node_id")).distinct()))
    skipped = checked.where(F.col("skip_reason").isNotNull()).select("group_id", "n_arrays", F.lit("skipped").alias("status"), "skip_reason")
    alignment = aligned(held.join(checked.where(F.col("skip_reason").isNull()).select("group_id"), "group_id"))
    of = lambda a: trees.join(a.select("group_id").distinct(), "group_id", "left_semi") if trees is not None else estimated_trees(a, settings.tree_construction_method, more)
    forward = one_direction(alignment, of(alignment), settings)
    out = {"events": forward.events, "trees": forward.trees, "alignment": forward.alignment, "duplicates": forward.duplicates, "states": forward.states, "rank": forward.rank}
    out |= pooled_estimates(forward, settings.group_by, settings.significance_level)
    protocol = forward.protocol
    if settings.determine_orientation:
        other = mirrored(alignment)
        backward = one_direction(other, of(other), settings)
        choice = _held(orient.compare(forward.protocol, backward.protocol, boundary=settings.orientation_decision_boundary))
        out["orientations"] = choice.select("group_id", "lnl_forward", "lnl_backward", "difference", "recommendation", "orientation")
        for name in ("events", "trees", "duplicates", "states", "rank"):
            out[name] = orient.chosen_rows(choice, getattr(forward, name), getattr(backward, name))
        protocol = choice.withColumn("lnl_bdm", F.when(F.col("recommendation") == "reverse", F.col("lnl_backward")).otherwise(F.col("lnl_forward")))
    protocol = protocol.join(before, "group_id", "left")
    if names is not None:
        protocol = protocol.join(names, "group_id", "left")
    out["protocol"] = _held(orient.merged_protocols(protocol, skipped.withColumn("n_arrays", F.col("n_arrays").cast("long"))))
    return out


def grouped_finder_arrays(found: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(arrays, clusters) from a finder's arrays: one reading of each repeat, spacers of one repeat within `most` edits
    as one token (none for null), and groups of arrays of one repeat that share a token."""
    read = _held(cluster.by_repeat(found).withColumn("array_id", F.concat_ws("_", "sequence_id", "array_id")))
    rows = read.select("repeat", "array_id", F.posexplode("tokens").alias("pos", "sequence"))
    place = F.struct("array_id", "pos")
    first = rows.groupBy("repeat", "sequence").agg(F.min(place).alias("ord"))
    clusters = first.select("repeat", "sequence", F.col("sequence").alias("representative"))
    if most is not None:
        ordered = first.withColumn("ord", F.row_number().over(Window.partitionBy("repeat").orderBy("ord", "sequence")))
        clusters = cluster.greedy_leader(ordered, "sequence", most)
    clusters = _held(clusters)
    named = _held(rows.join(clusters, ["repeat", "sequence"]).select(F.col("repeat").alias("group_id"), "array_id", "pos", F.col("representative").alias("token")))
    groups = cluster.greedy_overlap(named)
    grouped = named.join(groups, ["group_id", "array_id"]).select(F.concat_ws("_", "cluster", "group_id").alias("group_id"), "array_id", "pos", "token")
    return grouped, clusters


def read_input(spark: SparkSession, settings: readers.Settings) -> tuple[DataFrame, DataFrame | None]:
    """(arrays, clusters or null) of the settings' input."""
    more, kind = options(settings), settings.input_type
    most = more["cluster_spacers_max_distance"]
    most = (settings.clusters_max_distance if most is None else int(most)) if more["cluster_spacers"] else None
    if kind == "ccdb":
        strands = readers.read_strands(spark, settings.input_path)
        if most is None:
            return readers.enumerated(strands).withColumn("token", F.col("token").cast("string")), None
        clusters = _held(cluster.single_linkage(strands, "sequence", most))
        renamed = strands.join(clusters, "sequence").withColumn("sequence", F.col("representative")).drop("representative")
        return readers.enumerated(renamed).withColumn("token", F.col("token").cast("string")), clusters
    if kind == "ccf_json":
        return grouped_finder_arrays(readers.read_finder(spark, f"{settings.input_path}/*/result.json", settings.min_evidence_level), most)
    if kind == "named_lists":
        return readers.read_named_lists(spark, settings.input_path), None
    return readers.read_arrays(spark, settings.input_path, None if settings.input_path.endswith((".fa", ".fasta", ".fna")) else readers.FASTA_GLOB), None


def main(arguments: list[str]) -> None:
    began = time.time()
    settings = readers.Settings.from_lines(arguments)
    more = options(settings)
    logging.basicConfig(level=[logging.ERROR, logging.INFO, logging.DEBUG][int(more["verbosity"])])
    spark = SparkSession.builder.appName("stemma").getOrCreate()
    held, clusters = read_input(spark, settings)
    if named := more["exclude_groups"]:
        held = held.where(~F.col("group_id").isin([x.strip() for x in named.split(",")]))
    held = _held(held)
    trees = None
    if path := more["tree_path"]:
        trees = readers.tree_nodes(readers.read_tree_map(spark, path) if path.endswith(".json") else readers.bind_trees(held, readers.read_tree_files(spark, path))).select("group_id", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("branch_length"))
    out = run(held, settings, trees)
    to = settings.output_path
    sinks.write_results(out["protocol"], f"{to}/0_results")
    sinks.write_by_status(out["protocol"], f"{to}/protocol")
    sinks.newick(out["trees"]).write.mode("overwrite").json(f"{to}/trees")
    out["events"].write.mode("overwrite").parquet(f"{to}/events")
    sinks.as_json_map(out["rank"], "token", "rank", "group_id").write.mode("overwrite").json(f"{to}/token_numbers")
    for name in ("orientations", "pooled", "overall"):
        if name in out:
            out[name].write.mode("overwrite").option("header", True).csv(f"{to}/{name}")
    if clusters is not None:
        sinks.as_json_map(clusters, "sequence", "representative", *(c for c in ("repeat",) if c in clusters.columns)).write.mode("overwrite").json(f"{to}/clusters")
    if more["save_reconstructed_events"]:
        sinks.event_bundle(out["states"], out["events"], out["rank"], out["trees"], out["duplicates"]).write.mode("overwrite").json(f"{to}/reconstructed_events")
    sinks.summary_lines(out["protocol"].where(F.col("status") != "skipped"), settings.significance_level).select("line").write.mode("overwrite").text(f"{to}/summary")
    log.info("the run took %.1f s", time.time() - began)


if __name__ == "__main__":
    main(sys.argv[1:])
