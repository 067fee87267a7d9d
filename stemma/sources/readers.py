"""Readers: array files, strand folders, finder results, trees, tables with lists in text; all through Spark's readers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions.scalar import EVIDENCE, header_name, reverse_complement_n

from .newick import parse

FASTA_GLOB = "*.{fa,fasta,fna}"


def _path() -> Column:
    """A row's file, without the escapes of its address; a plus sign is none of them."""
    return F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))


def records(spark: SparkSession, path: str, glob: str | None = FASTA_GLOB) -> DataFrame:
    """path, ord, header, sequence (the line behind the header). A file is one row of the scan."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path, wholetext=True).select(_path().alias("path"), F.posexplode(F.split("value", "(?m)^>")).alias("ord", "record")).where((F.col("ord") > 0) & (F.trim("record") != ""))
    lines = F.split("record", r"\r?\n")
    return text.select("path", "ord", F.trim(F.get(lines, F.lit(0))).alias("header"), F.trim(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("sequence"))


def read_arrays(spark: SparkSession, path: str, glob: str | None = FASTA_GLOB) -> DataFrame:
    """group_id (file name to its first dot), array_id (header to its first comma), pos, token; the last of equal names wins."""
    from stemma.functions.scalar import group_name

    r = records(spark, path, glob).withColumn("group_id", group_name(F.col("path"))).withColumn("array_id", header_name(F.col("header")))
    last = r.groupBy("group_id", "array_id").agg(F.max_by("sequence", "ord").alias("sequence"))
    tokens = F.split(F.replace("sequence", F.lit(" "), F.lit("")), ",")
    return last.select("group_id", "array_id", F.posexplode(tokens).alias("pos", "token")).where(F.col("token") != "")


def read_array_folders(spark: SparkSession, path: str) -> DataFrame:
    """kind, group_id, array_id, pos, token of the folders that `sinks.write_arrays` makes."""
    text = spark.read.text(path, wholetext=True).select("kind", F.col("group_id").cast("string").alias("group_id"), F.explode(F.split("value", "(?m)^>")).alias("record")).where(F.trim("record") != "")
    lines = F.split("record", r"\r?\n")
    tokens = F.split(F.replace(F.get(lines, F.lit(1)), F.lit(" "), F.lit("")), ",")
    return text.select("kind", "group_id", F.trim(F.get(lines, F.lit(0))).alias("array_id"), F.posexplode(tokens).alias("pos", "token")).where(F.col("token") != "")


def read_strands(spark: SparkSession, folder: str) -> DataFrame:
    """group_id (folder), array_id (file), pos, sequence from pos_strand/ and neg_strand/; the latter turned around."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(_path().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "sequence"))
    parts = F.split("path", "/")
    lines = lines.select(F.element_at(parts, -3).alias("group_id"), F.element_at(parts, -2).alias("strand"), F.substring_index(F.element_at(parts, -1), ".", 1).alias("array_id"), "line", F.trim("sequence").alias("sequence"))
    lines = lines.where((F.col("sequence") != "") & ~F.startswith("sequence", F.lit(">")) & F.col("strand").isin("pos_strand", "neg_strand"))
    minus = F.col("strand") == "neg_strand"
    order = F.when(minus, -F.col("line")).otherwise(F.col("line"))
    return lines.select("group_id", "array_id", "strand", (F.row_number().over(Window.partitionBy("group_id", "strand", "array_id").orderBy(order)) - 1).alias("pos"), F.when(minus, reverse_complement_n(F.col("sequence"))).otherwise(F.col("sequence")).alias("sequence"))


def enumerated(strands: DataFrame) -> DataFrame:
    """group_id, array_id, pos, token: sequences numbered from 0 by first occurrence in a group, plus strand first."""
    place = F.struct(F.when(F.col("strand") == "pos_strand", 0).otherwise(1).alias("s"), "array_id", "pos")
    first = strands.groupBy("group_id", "sequence").agg(F.min(place).alias("at"))
    ids = first.withColumn("token", F.row_number().over(Window.partitionBy("group_id").orderBy("at")) - 1).drop("at")
    return strands.join(ids, ["group_id", "sequence"]).select("group_id", "array_id", "pos", "token")


FINDER = "Sequences array<struct<Id:string,Length:bigint,Crisprs:array<struct<Name:string,Start:bigint,End:bigint,Evidence_Level:int,DR_Consensus:string,CRISPRDirection:string,Potential_Orientation:string,Regions:array<struct<Type:string,Sequence:string>>>>>>"


def read_finder(spark: SparkSession, paths: str | list[str], evidence: int = EVIDENCE) -> DataFrame:
    """sequence_id, array_id, start, end, direction, orientation, repeat, tokens, repeats of arrays with enough evidence."""
    found = spark.read.schema(FINDER).option("multiLine", True).json(paths).select(F.explode("Sequences").alias("s")).select(F.col("s.Id").alias("sequence_id"), F.explode("s.Crisprs").alias("c"))
    of = lambda kind: F.transform(F.filter("c.Regions", lambda r: r["Type"] == kind), lambda r: r["Sequence"])
    return found.where(F.col("c.Evidence_Level") >= evidence).select("sequence_id", F.col("c.Name").alias("array_id"), F.col("c.Start").alias("start"), F.col("c.End").alias("end"), F.col("c.CRISPRDirection").alias("direction"), F.col("c.Potential_Orientation").alias("orientation"), F.col("c.DR_Consensus").alias("repeat"), of("Spacer").alias("tokens"), of("DR").alias("repeats"))


def read_named_lists(spark: SparkSession, path: str) -> DataFrame:
    """group_id, array_id, pos, token from files of `name: a, b, c` lines under a head in parentheses."""
    from stemma.functions.scalar import group_name

    text = spark.read.text(path, wholetext=True).select(group_name(_path()).alias("group_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "row"))
    rows = text.where(F.col("row").contains(":") & ~F.startswith(F.trim("row"), F.lit("(")))
    tokens = F.transform(F.split(F.substring_index(F.substring_index("row", ":", 2), ":", -1), ","), lambda t: F.trim(t))
    return rows.select("group_id", F.trim(F.substring_index("row", ":", 1)).alias("array_id"), F.posexplode(tokens).alias("pos", "token"))


NODES = "node_id string, parent_id string, branch_length double, depth int, is_leaf boolean, pre_ord int"


def tree_nodes(trees: DataFrame, text: str = "newick") -> DataFrame:
    """trees' other columns and a row for each node of its Newick text; none for null."""
    rest = [f for f in trees.schema.fields if f.name != text]
    names = [f.name for f in rest]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.dropna(subset=[text]).itertuples(index=False):
                nodes = pd.DataFrame([tuple(n) for n in parse(row[-1])], columns=[c.split()[0] for c in NODES.split(", ")])
                for k, name in enumerate(names):
                    nodes.insert(k, name, [row[k]] * len(nodes))
                yield nodes

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), NODES])
    return trees.select(*names, text).mapInPandas(run, schema)


def read_tree_map(spark: SparkSession, path: str) -> DataFrame:
    """group_id, newick from a JSON object of groups' trees."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("group_id", "newick"))


def read_tree_files(spark: SparkSession, path: str) -> DataFrame:
    """file, newick: a tree in each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(_path(), "/"), -1).alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("newick"))


def bind_trees(groups: DataFrame, files: DataFrame) -> DataFrame:
    """group_id, newick: the first file, by name, that begins with the group's name; groups without one are left out."""
    met = groups.select("group_id").distinct().join(files, F.startswith(files["file"], F.col("group_id")))
    return met.groupBy("group_id").agg(F.min_by("newick", "file").alias("newick"))


def without_tree(groups: DataFrame, trees: DataFrame) -> DataFrame:
    return groups.select("group_id").distinct().join(trees.select("group_id").distinct(), "group_id", "left_anti")


def parse_lists(rows: DataFrame, *columns: str, kind: str = "array<double>") -> DataFrame:
    """Lists written as text, '[1.0, 2.0]' or '(1, 2)', as arrays; nan counts as null."""
    out = rows
    for c in columns:
        text = F.regexp_replace(F.translate(F.col(c).cast("string"), "()'", "[]\""), r"\bnan\b", "null")
        out = out.withColumn(c, F.from_json(text, kind))
    return out


def read_lists_csv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return parse_lists(spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path), *columns)


def read_result(spark: SparkSession, path: str, exclude: list[str] = ()) -> DataFrame:
    """A written protocol without excluded groups."""
    rows = spark.read.parquet(path)
    return rows.where(~F.col("group_id").isin(list(exclude))) if exclude else rows


@dataclass(frozen=True)
class Settings:
    """What a run needs to know; `from_file` reads one argument a line, as `--name` lines followed by values."""

    input_path: str = ""
    output_path: str = ""
    input_type: str = "spacer_fasta"
    tree_construction_method: str = "upgma"
    distance_function: str = "likelihood"
    significance_level: float = 0.05
    orientation_decision_boundary: float = 5.0
    min_evidence_level: int = 4
    clusters_max_distance: int = 1
    min_arrays: int = 2
    seed: int = 2357
    combine_non_unique_arrays: bool = False
    determine_orientation: bool = False
    group_by: str | int | None = None
    more: dict = field(default_factory=dict)

    @classmethod
    def from_lines(cls, lines: list[str]) -> Settings:
        known, out, more, name = cls.__dataclass_fields__, {}, {}, None
        for x in (x.strip() for x in lines):
            if not x or x.startswith("#"):
                continue
            if x.startswith("--"):
                name = x[2:].replace("-", "_")
                out[name] = "True"
            elif name:
                out[name], name = x, None
            else:
                out["output_path" if "input_path" in out else "input_path"] = x
        for k in [k for k in out if k not in known]:
            more[k] = out.pop(k)
        kinds = {"bool": lambda v: v.lower() in ("true", "1"), "int": int, "float": float}
        return cls(**{k: kinds.get(str(known[k].type), lambda v: v)(v) for k, v in out.items()}, more=more)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Settings:
        return cls.from_lines([r[0] for r in spark.read.text(path).collect()])
