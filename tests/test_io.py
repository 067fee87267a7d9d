import json

from pyspark.sql import functions as F

from stemma import sinks
from stemma.sources import newick, readers


def test_arrays_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "G1.x.fa").write_text(">a, more\n1, 2,3\n> b \n4\nignored\n>a\n9, 8\n")
    (tmp_path / "in" / "other.txt").write_text(">z\n1\n")
    got = readers.read_arrays(spark, str(tmp_path / "in"))
    assert {(r.group_id, r.array_id, r.pos, r.token) for r in got.collect()} == {("G1", "a", 0, "9"), ("G1", "a", 1, "8"), ("G1", "b", 0, "4")}
    sinks.write_arrays(got, str(tmp_path / "out"), small=3)
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect())
    assert ">a\n9, 8" in text and (tmp_path / "out" / "kind=small_groups").exists()


def test_strands(spark, tmp_path):
    for strand, name, text in (("pos_strand", "x.fa", ">h\nACG\nTTT\n"), ("neg_strand", "y.fa", ">1\nAAA\n>2\nCGT\n")):
        (tmp_path / "g" / strand).mkdir(parents=True)
        (tmp_path / "g" / strand / name).write_text(text)
    strands = readers.read_strands(spark, str(tmp_path))
    got = {(r.array_id, r.pos): r.token for r in readers.enumerated(strands).collect()}
    assert got == {("x", 0): 0, ("x", 1): 1, ("y", 0): 0, ("y", 1): 1}


def test_finder(spark, tmp_path):
    array = lambda name, level: {"Name": name, "Start": 5, "End": 9, "Evidence_Level": level, "DR_Consensus": "ACG", "CRISPRDirection": "-", "Potential_Orientation": "+", "Spacers": 1, "Regions": [{"Type": "DR", "Sequence": "ACG"}, {"Type": "Spacer", "Sequence": "AAC"}, {"Type": "Spacer", "Sequence": "GGT"}]}
    path = tmp_path / "result.json"
    path.write_text(json.dumps({"Sequences": [{"Id": "s", "Length": 10, "Cas": [], "Crisprs": [array("one", 4), array("two", 1)]}, {"Id": "t", "Length": 1, "Cas": [], "Crisprs": []}]}, indent=1))
    rows = readers.read_finder(spark, str(path)).collect()
    assert [(r.array_id, r.tokens, r.repeats) for r in rows] == [("one", ["AAC", "GGT"], ["ACG"])]
    from stemma.operators.cluster import by_repeat

    assert by_repeat(readers.read_finder(spark, str(path))).first().tokens == ["ACC", "GTT"]


def test_newick(spark, tmp_path):
    nodes = newick.parse("((a:1,b:2)x:0.5,'c d':3);")
    assert [(n.node_id, n.parent_id, n.branch_length, n.depth) for n in nodes] == [("in_0", None, None, 0), ("x", "in_0", 0.5, 1), ("a", "x", 1.0, 2), ("b", "x", 2.0, 2), ("c d", "in_0", 3.0, 1)]
    text = newick.write([(n.node_id, n.parent_id, n.branch_length) for n in nodes])
    again = newick.parse(text)
    assert {(n.node_id, n.parent_id, n.branch_length) for n in again} == {(n.node_id, n.parent_id, n.branch_length) for n in nodes}
    (tmp_path / "trees.json").write_text(json.dumps({"g": "(a:1,b:1);", "h": "(c,d);"}))
    trees = readers.read_tree_map(spark, str(tmp_path / "trees.json"))
    assert readers.tree_nodes(trees).where("is_leaf").count() == 4
    groups = spark.createDataFrame([("g",), ("k",)], "group_id string")
    files = spark.createDataFrame([("g_tree.nwk", "(a,b);"), ("g.nwk", "(c,d);")], "file string, newick string")
    assert [tuple(r) for r in readers.bind_trees(groups, files).collect()] == [("g", "(c,d);")]
    assert [r[0] for r in readers.without_tree(groups, trees).collect()] == ["k"]
    back = sinks.newick(readers.tree_nodes(trees).withColumn("parent_id", F.col("parent_id")))
    assert {r.group_id for r in back.collect()} == {"g", "h"}


def test_texts_and_settings(spark, tmp_path):
    (tmp_path / "old.txt").write_text("('x', 'y')\n\nname1: a, b\nname2: c\n")
    got = {(r.array_id, r.pos, r.token) for r in readers.read_named_lists(spark, str(tmp_path / "old.txt")).collect()}
    assert got == {("name1", 0, "a"), ("name1", 1, "b"), ("name2", 0, "c")}
    rows = spark.createDataFrame([("[1.0, nan, 2]",)], "x string")
    assert readers.parse_lists(rows, "x").first().x == [1.0, None, 2.0]
    s = readers.Settings.from_lines(["in", "out", "--seed", "5", "--determine_orientation", "--unknown", "3"])
    assert (s.input_path, s.output_path, s.seed, s.determine_orientation, s.more) == ("in", "out", 5, True, {"unknown": "3"})


def test_result_sinks(spark, tmp_path):
    p = spark.createDataFrame([("g", "main", [1, 2], 0.5), ("h", "trivial", [3], 0.1)], "group_id string, status string, sizes array<int>, lrt double")
    sinks.write_results(p, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_by_status(p, str(tmp_path / "parts"))
    assert (tmp_path / "parts" / "status=main").exists()
    assert json.loads(sinks.as_json_map(p, "group_id", "lrt").first().json) == {"g": 0.5, "h": 0.1}
