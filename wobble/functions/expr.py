"""Column expressions that stay in the JVM: logarithms with guards, curves over arrays, hashing and small combinatorics.

Undefined (NaN), unreachable (infinity) and not collected (null) are three different results and are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: Thresholds of an information curve: twenty steps of 0.05 as floating-point products, so that 0.3, 0.6 and 0.7 are missed by equal scores.
GRID = [i * 0.05 for i in range(21)]


def inf() -> Column:
    return F.lit(INF)


def nan() -> Column:
    return F.lit(NAN)


def bits(share: Column) -> Column:
    """``-log2(share)``; infinity for no share, and never a negative zero."""
    return F.when(share <= 0, inf()).otherwise(-F.log2(share) + F.lit(0.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: a lambda's argument is not put in place of its name, as a column is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 for an empty one."""
    part = lambda x, n: F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(0.0)
    h = let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda n: F.aggregate(counts, F.lit(0.0), lambda a, x: a + part(x, n)))
    return F.when(F.coalesce(F.size(counts), F.lit(0)) == 0, 0.0).otherwise(h + 0.0)


def fi_at(scores: Column, k: float, guard: float = 0.0) -> Column:
    """Functional information of threshold ``k`` over an array of scores."""
    n = F.size(scores)
    passing = F.size(F.filter(scores, lambda f: f >= k - guard))
    return F.when(n > 0, bits(passing / n))


def fi_curve(scores: Column, ks: list[float] = GRID) -> Column:
    """The curve over the thresholds, unclamped."""
    return F.array(*(fi_at(scores, k) for k in ks))


def aufi(curve: Column, n: Column, ks: list[float] = GRID) -> Column:
    """Trapezoid area under a curve clamped at ``log2(max(n, 1) + 1)``."""

    def area(curve: Column) -> Column:
        total = F.lit(0.0)
        for i in range(1, len(ks)):
            total = total + (curve[i] + curve[i - 1]) * ((ks[i] - ks[i - 1]) / 2)
        return total

    cap = F.log2(F.greatest(n, F.lit(1)) + F.lit(1.0))
    return let(F.transform(curve, lambda x: F.least(x, cap)), area)


def rho_f(scores: Column, k: Column | int) -> Column:
    """One-way intraclass correlation of success rates of ``k`` trials each, in [0, 1]; NaN if undefined."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(scores)
    over = lambda f: F.aggregate(scores, F.lit(0.0), lambda a, x: a + f(x))
    msb = let(over(lambda x: x) / n, lambda mean: k * over(lambda x: (x - mean) * (x - mean)) / F.when(n > 1, n - 1))
    msw = over(lambda x: k * x * (1 - x)) / (n * F.when(k > 1, k - 1))
    share = lambda b, w: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (b - w) / F.when(b + (k - 1) * w > 0, b + (k - 1) * w)))
    value = lambda m: F.when((n < 2) | (m["b"] + (k - 1) * m["w"] <= 0), nan()).otherwise(share(m["b"], m["w"]))
    return F.when(F.assert_true(k >= 2).isNull(), let(F.struct(msb.alias("b"), msw.alias("w")), value))


def fi_premium(scores: Column, low: float = 0.5, high: float = 1.0) -> Column:
    """Extra bits of the strict threshold over the lenient one, both clamped; NaN for no score."""
    if low >= high:
        raise ValueError("the lenient threshold must lie below the strict one")
    cap = F.log2(F.size(scores) + F.lit(1.0))
    at = lambda k: F.least(fi_at(scores, k, 1e-9), cap)
    return F.when(F.coalesce(F.size(scores), F.lit(0)) == 0, nan()).otherwise(F.greatest(F.lit(0.0), at(high) - at(low)) + 0.0)


def fi_spec(m0: Column, m_valid: Column) -> Column:
    return F.when((m0 <= 0) | (m_valid <= 0), 0.0).otherwise(F.log2(m0 / F.when(m_valid > 0, m_valid)) + 0.0)


def hazen(values: Column, lower: Column, upper: Column, jump: float = 0.1) -> Column:
    """Steps of a curve: where neighbouring intervals are apart and the values differ by more than ``jump`` bits.

    A struct of ``plateaus, steps, locations`` (places from 0, of the value before the step), ``falling`` (no value rises)
    and ``fits`` (a step at least).
    """
    n = F.size(values)
    pairs = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))

    def step(i: Column) -> Column:
        apart = (F.get(upper, i) < F.get(lower, i + 1)) | (F.get(upper, i + 1) < F.get(lower, i))
        return apart & (F.abs(F.get(values, i + 1) - F.get(values, i)) > jump)

    at = F.filter(pairs, step)
    rises = F.exists(pairs, lambda i: F.get(values, i + 1) > F.get(values, i) + 1e-9)
    return F.struct(
        F.when(n < 2, n).otherwise(F.size(at) + 1).alias("plateaus"), F.size(at).alias("steps"), at.alias("locations"), (~rises).alias("falling"), (F.size(at) > 0).alias("fits")
    )


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval of a proportion."""
    below = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / below
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


# hashes and seeds


def stable_hash(text: Column) -> Column:
    """The first 32 bits of the SHA-256, less the sign bit."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def seed32(text: Column) -> Column:
    """The first 32 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def sha_mod(text: Column, m: Column) -> Column:
    """The whole SHA-256 as a number, modulo ``m``: the hexadecimal digits folded from the left."""
    digits = F.split(F.sha2(text, 256), "")
    value = lambda d: F.conv(d, 16, 10).cast("long")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + value(d), m.cast("long")))


def target_index(question: Column, m0: Column, seed: int) -> Column:
    return sha_mod(F.concat(question, F.lit(f"::{seed}")), m0)


def mid_subset(question: Column, m0: Column, target: Column, seed: int) -> Column:
    """The target and the interpretations with the lowest hashes, half of all together (rounded up), in order."""
    others = F.filter(F.sequence(F.lit(0), (m0 - 1).cast("int")), lambda i: i != target)
    ranked = F.array_sort(F.transform(others, lambda i: F.struct(F.sha2(F.concat(question, F.lit(f"::{seed}::mid::"), i.cast("string")), 256).alias("h"), i.alias("i"))))
    half = F.ceil(m0 / 2).cast("int")
    picked = F.transform(F.slice(ranked, F.lit(1), half - 1), lambda s: s["i"])
    return F.array_sort(F.concat(F.array(target.cast("int")), picked))


# closed forms


def miss_probability(n: Column, k: Column, level: Column) -> Column:
    """Probability that ``level`` of ``n`` items drawn hold none of ``k``, as a product of ratios."""
    steps = F.when(level > 0, F.sequence(F.lit(0), (level - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda a, i: a * F.greatest(n - k - i, F.lit(0)) / (n - i))


def b_theo(n: Column, k: Column, level: Column) -> Column:
    """Bits of drawing a gold item at a level; infinity where that cannot be."""
    p = F.when((level <= 0) | (k <= 0), 0.0).when(level > n - k, 1.0).otherwise(1 - miss_probability(n, k, level))
    return F.when(F.assert_true(level <= n).isNull(), bits(p))


def b_emp(above: Column, below: Column) -> Column:
    return F.when(below <= 0, inf()).when(above <= 0, -inf()).otherwise(F.log2(above / F.when(below > 0, below)) + 0.0)


def hop_coverage(n: Column, hops: Column, level: Column) -> Column:
    return F.when((n <= 0) | (hops <= 0), 0.0).otherwise(F.greatest(F.lit(0), F.least(level, n)) / F.when(n > 0, n))


def layers(fractions: list[float], n: Column) -> Column:
    """Distinct layers at fractions of the depth, rounded half to even, from 1 to ``n``."""
    at = F.transform(F.array(*(F.lit(float(f)) for f in fractions)), lambda x: F.bround(x * n).cast("int"))
    return F.array_distinct(F.transform(at, lambda x: F.greatest(F.lit(1), F.least(n.cast("int"), x))))


# similarity


def total_variation(p: Column, q: Column) -> Column:
    """Half the sum of all differences of two distributions over one support; arrays of unlike sizes are an error."""
    gap = F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda total, d: total + d) / 2
    unlike = F.raise_error(F.concat(F.lit("distributions over "), F.size(p).cast("string"), F.lit(" and "), F.size(q).cast("string"), F.lit(" clusters"))).cast("double")
    return F.when(F.size(p) == F.size(q), gap).when(p.isNotNull() & q.isNotNull(), unlike)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def greedy_distinct(texts: Column, distance: int) -> Column:
    """In order, the texts that are at least ``distance`` edits from every one kept before; blanks are never kept."""
    near = lambda kept, x: F.exists(kept, lambda k: F.levenshtein(k, x) < distance)
    start = F.array().cast("array<string>")
    return F.aggregate(texts, start, lambda kept, x: F.when((F.trim(x) == "") | near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def distance_to(row: Column, other: Column) -> Column:
    """Euclidean distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(row, other, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda a, x: a + x))
