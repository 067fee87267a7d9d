"""Column functions: sequences, likelihoods, tests and labels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the models and tests use by default.
GUIDE_GAIN, GUIDE_LOSS = 1e-5, 1e-1
SIMPLE_DISTANCE = {"gain": 6522.48, "loss": 137.20, "alpha": 2.7278}
PRECISE_DISTANCE = {"gain": 0.6108, "loss": 0.1830, "alpha": 3.3377}
MIN_BRANCH, MAX_BRANCH = 1e-6, 20.0
TINY = 1e-40
SIGNIFICANCE, BOUNDARY, EVIDENCE = 0.05, 5.0, 4
LOG_CUT = -0.693


def reverse_complement(seq: Column) -> Column:
    """Unknown bases stay."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def reverse_complement_n(seq: Column) -> Column:
    """Unknown bases become N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGTN]", "N")), "ACGT", "TGCA")


def clean_dna(seq: Column) -> Column:
    return F.upper(F.regexp_replace(seq, "[ \n\r\t]", ""))


def accession(name: Column) -> Column:
    """The name without its last part behind an underscore."""
    return F.regexp_replace(name, "_[^_]*$", "")


def group_name(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def header_name(header: Column) -> Column:
    return F.trim(F.substring_index(header, ",", 1))


def without_gaps(tokens: Column, gap: str = "-") -> Column:
    return F.filter(tokens, lambda t: t != gap)


def duplicate_suffix(k: Column) -> Column:
    """A, B, ... Z, AA, BB, ... for the k-th copy, k from 0."""
    return F.repeat(F.char(65 + k % 26), F.floor(k / 26).cast("int") + 1)


def geometric(k: Column, alpha: Column) -> Column:
    """Probability of a block of k with mean alpha; all mass at 1 for alpha 1."""
    return F.when(alpha == 1, F.when(k == 1, 1.0).otherwise(0.0)).otherwise(F.pow(1 - 1 / alpha, k - 1) / alpha)


def block_likelihood(k: Column, loss: Column, alpha: Column, t: Column) -> Column:
    """Of losing a block of k tokens along a branch: p q (1 - q (1 - p))^(k - 1)."""
    p, q = 1 - F.exp(-loss * t), 1 / alpha
    return F.greatest(F.lit(TINY), p * q * F.pow(1 - q * (1 - p), k - 1))


def log1mexp(x: Column) -> Column:
    """ln(1 - exp(x)) for x < 0."""
    return F.when(x < LOG_CUT, F.log1p(-F.exp(x))).otherwise(F.log(-F.expm1(x)))


def log_factorial(k: Column) -> Column:
    return F.when(k < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double"))))


def poisson_log(k: Column, mean: Column) -> Column:
    return k * F.log(mean) - mean - log_factorial(k)


def transition(gain: float | Column, loss: float | Column, t: Column, parent: int, child: int) -> Column:
    """Of the two-state chain: probability of child's state, given the parent's, after time t."""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (gain, loss))
    e = F.exp(-(a + b) * t)
    return {(0, 0): b + a * e, (0, 1): a * (1 - e), (1, 0): b * (1 - e), (1, 1): a + b * e}[parent, child] / (a + b)


def chi2_quantile(significance: float = SIGNIFICANCE) -> float:
    """Upper quantile with one degree of freedom."""
    return NormalDist().inv_cdf(1 - significance / 2) ** 2


def ratio_test(ln_simple: Column, ln_full: Column, significance: float = SIGNIFICANCE) -> Column:
    return 2 * (ln_full - ln_simple) > chi2_quantile(significance)


def unbiased_alpha(alpha: Column, n: Column) -> Column:
    """Bias-corrected mean block length from n blocks."""
    p = 1 / alpha
    shifted = (n + 1 - F.sqrt(F.greatest(F.lit(0.0), F.pow(n + 1, F.lit(2.0)) - 4 * n * p))) / 2
    return F.greatest(F.lit(1.0), 1 / shifted)


def decision(difference: Column, boundary: float = BOUNDARY) -> Column:
    """forward, reverse or nd; the boundary itself and not-a-number are undecided."""
    sure = difference.isNotNull() & ~F.isnan(difference)
    return F.when(sure & (difference < -boundary), "reverse").when(sure & (difference > boundary), "forward").otherwise("nd")


def digitize(x: Column, bounds: list[float]) -> Column:
    """Bin number: the first and last bounds are bins of their own, those between are (low, high]."""
    out = F.when(x <= bounds[0], 0)
    for i, b in enumerate(bounds[1:-1], 1):
        out = out.when(x <= b, i)
    return out.when(x < bounds[-1], len(bounds) - 1).otherwise(len(bounds))


def estimated_gain(model: Column, loss: Column, length: Column, alpha: Column) -> Column:
    """The insertion rate that keeps the mean length."""
    return F.when(model == "block", loss * length * alpha).otherwise(loss * length)


def constant_length_loss(model: Column, gain: Column, length: Column, alpha: Column) -> Column:
    return F.when(model == "block", gain / (length * alpha)).otherwise(gain / length)


def fragment_pmf(n: Column, rate: Column) -> Column:
    """Of n tokens in the stationary law of the fragment model, where rate is gains per loss."""
    term = lambda i: (i + 1) * (i + 2) / (2 * rate)
    survived = F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(1.0), lambda a, i: a * (term(i) + 1))
    return term(n) / survived


def fragment_moments(rate: Column, limit: int = 1000) -> Column:
    """Struct of mean and variance of that law, summed up to limit."""
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(a: Column, i: Column) -> Column:
        t = (i + 1) * (i + 2) / (2 * rate)
        p = a["p"] * (t + 1)
        return F.struct(p.alias("p"), (a["m"] + i * t / p).alias("m"), (a["q"] + i * i * t / p).alias("q"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(limit)), zero, step, lambda a: F.struct(a["m"].alias("mean"), (a["q"] - a["m"] * a["m"]).alias("variance")))


def exponential(u: Column, rate: Column) -> Column:
    """A draw from a uniform one; infinite for rate 0."""
    return F.when(rate == 0, F.lit(math.inf)).otherwise(-F.log(u) / rate)


def coalescent_length(k: Column) -> Column:
    """Mean time with k lineages."""
    return 2 / (k * (k - 1))


def invert_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def nearest_distance(begin: Column, end: Column, genes: Column) -> Column:
    """From an array's ends to the nearest end of a gene (start, length)."""
    ends = F.flatten(F.transform(genes, lambda g: F.array(F.abs(begin - g["start"]), F.abs(begin - g["start"] - g["length"]), F.abs(end - g["start"]), F.abs(end - g["start"] - g["length"]))))
    return F.array_min(ends)


def clean_label(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("CAS-"), F.lit("")), F.lit("Type"), F.lit(""))


def flip(strand: Column, recommendation: Column) -> Column:
    """1 <-> 2 where a reversal is recommended."""
    return F.when(recommendation == "reverse", F.when(strand == 1, 2).when(strand == 2, 1).otherwise(strand)).otherwise(strand)


def consensus(codes: Column) -> Column:
    """Of a group's codes: all 3 -> 3, 1 with 2 -> 3, otherwise the decided one."""
    has = lambda c: F.array_contains(codes, c)
    return F.when(has(1) & has(2), 3).when(has(1), 1).when(has(2), 2).otherwise(3)


def agreement(mine: Column, other: Column) -> Column:
    """Five ways two decisions (1, 2 or 3 for none) can relate."""
    return F.when((mine == 3) & (other == 3), "none").when(mine == 3, "only other").when(other == 3, "only mine").when(mine == other, "agree").otherwise("disagree")
