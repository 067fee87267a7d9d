import math

from pyspark.sql import functions as F

from stemma.functions import scalar as fn


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_sequences(spark):
    r = one(spark, a=fn.reverse_complement(F.lit("ACGTN")), b=fn.reverse_complement(F.lit("ACGX")), c=fn.reverse_complement_n(F.lit("ACGX")), d=fn.clean_dna(F.lit("a c\tg\n")), e=fn.accession(F.lit("NC_1_2")), f=fn.group_name(F.lit("file:/x/G1.a.fa")))
    assert tuple(r) == ("NACGT", "XCGT", "NCGT", "ACG", "NC_1", "G1")


def test_block_likelihood_is_its_recursion(spark):
    p, alpha = 0.5, 2.0
    rho = -math.log(1 - p)
    got = spark.range(1, 8).select(fn.block_likelihood(F.col("id"), F.lit(rho), F.lit(alpha), F.lit(1.0)).alias("f")).collect()
    assert [round(r.f, 6) for r in got[:3]] == [0.25, 0.1875, 0.140625]


def test_bias_decision_and_bins(spark):
    assert round(one(spark, a=fn.unbiased_alpha(F.lit(4 / 3), F.lit(2))).a, 6) == 1.57735
    rows = spark.createDataFrame([(-5.01,), (-5.0,), (5.0,), (5.01,), (float("nan"),), (None,)], "d double")
    assert [r[0] for r in rows.select(fn.decision(F.col("d"))).collect()] == ["reverse", "nd", "nd", "forward", "nd", "nd"]
    bins = spark.createDataFrame([(0.0,), (0.5,), (0.75,), (1.0,)], "x double").select(fn.digitize(F.col("x"), [0.0, 0.5, 1.0])).collect()
    assert [r[0] for r in bins] == [0, 1, 2, 3]


def test_suffixes(spark):
    got = [r[0] for r in spark.range(28).select(fn.duplicate_suffix(F.col("id"))).collect()]
    assert got[:2] == ["A", "B"] and got[25:] == ["Z", "AA", "BB"]


def test_chain_and_numbers(spark):
    a, b, t = 0.3, 0.7, 0.4
    r = one(spark, **{f"p{i}{j}": fn.transition(a, b, F.lit(t), i, j) for i in (0, 1) for j in (0, 1)}, q=fn.log1mexp(F.lit(-0.1)), z=fn.poisson_log(F.lit(3), F.lit(2.0)), g=fn.geometric(F.lit(1), F.lit(1.0)), h=fn.exponential(F.lit(0.5), F.lit(0.0)))
    assert math.isclose(r.p00 + r.p01, 1) and math.isclose(r.p10 + r.p11, 1)
    n = 200_000  # against many small steps
    x = 1.0
    for _ in range(n):
        x = x * (1 - a * t / n) + (1 - x) * b * t / n
    assert math.isclose(r.p00, x, rel_tol=1e-5)
    assert math.isclose(r.q, math.log(1 - math.exp(-0.1))) and math.isclose(r.z, math.log(math.exp(-2) * 8 / 6)) and r.g == 1 and r.h == math.inf
    assert math.isclose(fn.chi2_quantile(0.05), 3.841458820694124, rel_tol=1e-9)


def test_fragment_law_sums_to_one(spark):
    got = spark.range(0, 60).select(F.sum(fn.fragment_pmf(F.col("id"), F.lit(3.0)))).first()[0]
    assert math.isclose(got, 1, abs_tol=1e-9)
    m = one(spark, m=fn.fragment_moments(F.lit(3.0), 60)).m
    assert m.mean > 0 and m.variance > 0


def test_labels(spark):
    r = one(spark, a=fn.consensus(F.array(F.lit(1), F.lit(2))), b=fn.consensus(F.array(F.lit(1), F.lit(3))), c=fn.consensus(F.array(F.lit(3))), d=fn.flip(F.lit(1), F.lit("reverse")), e=fn.agreement(F.lit(1), F.lit(2)), f=fn.clean_label(F.lit("CAS-TypeIE")))
    assert tuple(r) == (3, 1, 3, 2, "disagree", "IE")
    near = one(spark, n=fn.nearest_distance(F.lit(100), F.lit(200), F.array(F.struct(F.lit(250).alias("start"), F.lit(30).alias("length")))), m=fn.invert_map(F.create_map(F.lit("a"), F.lit(1))))
    assert near.n == 50 and near.m == {1: "a"}
