"""Per-cell metrics over long fact tables.

A cell is the group that a metric describes; its columns are given as ``cell``. Facts are rows of (cell, par,
sample) with a success ``y`` or a cluster; every metric is one aggregation by the cell's columns, so all of them
share one partitioning, and partial sums precede each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .factors import rank_correlation
from .lineage import written


def graded(samples: DataFrame, cell: list[str]) -> DataFrame:
    """``f``, the mean success of each paraphrase, and ``k``, its number of samples."""
    return samples.groupBy(*cell, "par").agg(F.avg(F.col("y").cast("double")).alias("f"), F.count("*").alias("k"))


def facts(graded_: DataFrame, cell: list[str], ks: list[float] = E.GRID) -> DataFrame:
    """What the input metrics of a cell need, in one partial aggregation: counts of passing scores and a few sums.

    ``n`` paraphrases, ``passing`` (how many reach each threshold), ``f_mean, low, high``, ``half`` and ``full`` (how many
    reach 0.5 and 1), and the sums ``trials, hits, squares, trials2`` of ``k, k f, k f f, k k``.
    """
    f, k = F.col("f"), F.col("k")
    reach = lambda x, guard=0.0: F.sum((f >= x - guard).cast("long"))
    return graded_.groupBy(*cell).agg(
        F.count("*").alias("n"), F.array(*(reach(x) for x in ks)).alias("passing"), F.avg("f").alias("f_mean"), F.min("f").alias("low"), F.max("f").alias("high"),
        reach(0.5, 1e-9).alias("half"), reach(1.0, 1e-9).alias("full"),
        F.sum(k).alias("trials"), F.sum(k * f).alias("hits"), F.sum(k * f * f).alias("squares"), F.sum(k * k).alias("trials2"),
    )


def curve() -> Column:
    """The information curve of a row of :func:`facts`, unclamped."""
    return F.transform("passing", lambda p: E.bits(p / F.col("n")))


def curves(facts_: DataFrame, cell: list[str]) -> DataFrame:
    """A row per cell and threshold: ``step, k, fi``."""
    rows = facts_.select(*cell, F.posexplode(curve()).alias("step", "fi"))
    return rows.select(*cell, "step", F.round(F.col("step") * 0.05, 2).alias("k"), "fi")


def intraclass() -> Column:
    """One-way intraclass correlation of a row of :func:`facts` in [0, 1], NaN if undefined; each paraphrase has its own number of trials.

    With equal numbers this is the balanced form, ``(msb - msw) / (msb + (k - 1) msw)``.
    """
    n, trials, hits = F.col("n"), F.col("trials"), F.col("hits")
    msb = (F.col("squares") - hits * hits / trials) / F.when(n > 1, n - 1)
    msw = (hits - F.col("squares")) / F.when(trials > n, trials - n)
    k0 = (trials - F.col("trials2") / trials) / F.when(n > 1, n - 1)
    below = msb + (k0 - 1) * msw
    # greatest() passes over nulls, so what is undefined is kept out of it
    value = F.when(below > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (msb - msw) / F.when(below > 1e-12, below))))
    return F.coalesce(value, E.nan())


def input_columns() -> list[Column]:
    """``f_mean, aufi, spread, rho_f, fi_premium, n_paraphrases`` of a row of :func:`facts`."""
    n = F.col("n")
    cap = F.log2(n + F.lit(1.0))
    at = lambda c: F.least(E.bits(F.col(c) / n), cap)
    premium = F.greatest(F.lit(0.0), at("full") - at("half")) + 0.0
    spread = F.col("high") - F.col("low")
    return [F.col("f_mean"), E.aufi(curve(), n).alias("aufi"), spread.alias("spread"), intraclass().alias("rho_f"), premium.alias("fi_premium"), n.alias("n_paraphrases")]


def input_metrics(facts_: DataFrame, cell: list[str]) -> DataFrame:
    """The input metrics of each cell."""
    return facts_.select(*cell, *input_columns())


def cluster_counts(samples: DataFrame, cell: list[str]) -> DataFrame:
    """``n`` samples of each paraphrase in each cluster, and ``first``, the first of them."""
    return samples.groupBy(*cell, "par", "cluster").agg(F.count("*").alias("n"), F.min("sample").alias("first"))


def entropies(counts: DataFrame, cell: list[str]) -> DataFrame:
    """``h``, the entropy of each paraphrase's clusters in bits."""
    # sum of -p log2 p = log2 N - sum(n log2 n) / N
    n = F.sum("n")
    h = F.log2(n.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n
    return counts.groupBy(*cell, "par").agg(F.greatest(h, F.lit(0.0)).alias("h"))


def answer_space(counts: DataFrame, cell: list[str]) -> DataFrame:
    """``a_q``, how many clusters each cell has, 1 at least."""
    return counts.groupBy(*cell).agg(F.greatest(F.lit(1), F.count_distinct("cluster")).cast("long").alias("a_q"))


def output_metrics(counts: DataFrame, cell: list[str]) -> DataFrame:
    """``h_sem_mean, h_sem_var, a_q, fi_out_mean, fi_out_var, s_tau_mean`` of each cell; variances are of populations."""
    joined = entropies(counts, cell).join(answer_space(counts, cell), cell)
    space = F.log2(F.col("a_q").cast("double"))
    out = F.greatest(F.lit(0.0), space - F.col("h"))
    tau = F.when(F.col("a_q") <= 1, 0.0).otherwise(F.col("h") / F.when(F.col("a_q") > 1, space))
    return joined.groupBy(*cell).agg(
        F.avg("h").alias("h_sem_mean"),
        F.var_pop("h").alias("h_sem_var"),
        F.max("a_q").alias("a_q"),
        F.avg(out).alias("fi_out_mean"),
        F.var_pop(out).alias("fi_out_var"),
        F.avg(tau).alias("s_tau_mean"),
    )


def consistency(counts: DataFrame, cell: list[str]) -> DataFrame:
    """Mean over all pairs of paraphrases of 1 less the total variation distance of their cluster shares.

    The pairs are never made: over sorted shares ``p_1 <= ... <= p_N`` of a cluster the sum of all differences is that of
    ``(2 r - N - 1) p_r``, and paraphrases without the cluster only move the ranks. Equal shares are counted first, so what
    is sorted is a row per share, of which there are few.
    """
    totals = counts.groupBy(*cell, "par").agg(F.sum("n").alias("total"))
    size = totals.groupBy(*cell).agg(F.count("*").alias("pars"))
    shares = counts.join(totals, [*cell, "par"]).select(*cell, "cluster", (F.col("n") / F.col("total")).alias("p")).groupBy(*cell, "cluster", "p").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*cell, "cluster").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    have = Window.partitionBy(*cell, "cluster")
    ranked = shares.withColumn("c", F.coalesce(F.sum("m").over(w), F.lit(0))).withColumn("have", F.sum("m").over(have)).join(size, cell)
    m, pars = F.col("m"), F.col("pars")
    term = F.col("p") * m * (2 * (F.col("c") + pars - F.col("have")) + m - pars)
    pairs = F.max("pars") * (F.max("pars") - 1) / 2
    value = F.when(F.max("pars") < 2, 1.0).otherwise(1 - F.sum(term) / 2 / F.when(pairs > 0, pairs))
    return ranked.groupBy(*cell).agg(value.alias("consistency"))


def proportions(counts: DataFrame, cell: list[str], support: list[int]) -> DataFrame:
    """``cell, par, shares``: of all samples of a paraphrase the share in each cluster of ``support``, in its order; those in other clusters only count as samples."""
    inside = [F.coalesce(F.sum(F.when(F.col("cluster") == c, F.col("n"))), F.lit(0)) / F.sum("n") for c in support]
    return counts.groupBy(*cell, "par").agg(F.array(*inside).alias("shares"))


def pool_distances(counts: DataFrame, cell: list[str]) -> DataFrame:
    """``cell, par, distance``: the total variation distance of each paraphrase's clusters to those of all samples of its cell.

    Clusters that a paraphrase has none of add their share of the pool, which is what its own clusters leave of it; so no row
    is made for them.
    """
    pool = counts.groupBy(*cell, "cluster").agg(F.sum("n").alias("m"))
    pool = pool.join(pool.groupBy(*cell).agg(F.sum("m").alias("all")), cell).select(*cell, "cluster", (F.col("m") / F.col("all")).alias("q"))
    own = counts.groupBy(*cell, "par").agg(F.sum("n").alias("total"))
    both = counts.join(own, [*cell, "par"]).join(pool, [*cell, "cluster"]).withColumn("p", F.col("n") / F.col("total"))
    return both.groupBy(*cell, "par").agg(((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("distance"))


def variation_ratio(counts: DataFrame, cell: list[str]) -> DataFrame:
    """1 less the share of paraphrases whose most frequent cluster is the commonest such; ties go to the cluster met first."""
    top = counts.groupBy(*cell, "par").agg(F.max_by("cluster", F.struct("n", (-F.col("first")).alias("first"))).alias("top"))
    return top.groupBy(*cell, "top").agg(F.count("*").alias("n")).groupBy(*cell).agg((1 - F.max("n") / F.sum("n")).alias("variation_ratio"))


def by_dimension(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """A row per number of ``embedding``: ``d, x``."""
    return vectors.select(*keys, F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))


def ess_in(vectors: DataFrame, cell: list[str]) -> DataFrame:
    """Sum over dimensions of the sample variance; 0 for fewer than two vectors."""
    spread = by_dimension(vectors, cell).groupBy(*cell, "d").agg(F.coalesce(F.nanvl(F.var_samp("x"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    return spread.groupBy(*cell).agg(F.sum("v").alias("ess_in"))


def rho_u(vectors: DataFrame, cell: list[str], epsilon: float = 1e-12) -> DataFrame:
    """Total, between and within covariance traces ``u_t, u_a, u_e`` of paraphrases' vectors, and ``rho_u``, the share within."""
    long = by_dimension(vectors, [*cell, "par"])
    inner = long.groupBy(*cell, "par", "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n, s = F.sum("n"), F.sum("s")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) / n - (s / n) * (s / n)
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / n
    traces = inner.groupBy(*cell, "d").agg(n.alias("n"), F.greatest(between, F.lit(0.0)).alias("a"), F.greatest(within, F.lit(0.0)).alias("e"))
    one = F.max("n") < 2
    u_a, u_e = (F.when(one, 0.0).otherwise(F.sum(c)) for c in ("a", "e"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u_e / (u_a + u_e + epsilon)))
    return traces.groupBy(*cell).agg((u_a + u_e).alias("u_t"), u_a.alias("u_a"), u_e.alias("u_e"), ratio.alias("rho_u"))


def posix(matrix: DataFrame, lengths: DataFrame, cell: list[str]) -> DataFrame:
    """Mean over i <> j of ``|lp(i, j) - lp(j, j)| / length(j)``; null if any entry is NaN, 0 for fewer than two rows."""
    own = matrix.where("i = j").select(*cell, "j", F.col("lp").alias("own"))
    joined = matrix.join(own, [*cell, "j"]).join(lengths.select(*cell, "j", "len"), [*cell, "j"])
    off = F.when(F.col("i") != F.col("j"), F.abs(F.col("lp") - F.col("own")) / F.col("len"))
    value = F.when(F.max(F.isnan("lp").cast("int")) == 1, None).otherwise(F.coalesce(F.avg(off), F.lit(0.0)))
    return joined.groupBy(*cell).agg(value.alias("posix_psi"))


def whole_matrices(matrix: DataFrame, cell: list[str]) -> DataFrame:
    """The entries ``i, j, lp`` of cells that have each pair of a prompt and an answer, as many answers as prompts."""
    size = matrix.groupBy(*cell).agg(F.count("*").alias("_n"), F.count_distinct("i").alias("_i"), F.count_distinct("j").alias("_j"))
    return matrix.join(size.where("_i = _j and _n = _i * _j").select(*cell), cell)


def choice_entropy(choices: DataFrame, cell: list[str], classes: int) -> DataFrame:
    """``s_tau``: entropy of counts ``n`` of a closed set of ``classes``, as a share of the greatest; 0 for no count or one class."""
    n = F.sum("n").cast("double")
    h = F.log2(n) - F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n").cast("double"))).otherwise(0.0)) / n
    value = F.when((n > 0) & F.lit(classes > 1), F.greatest(h, F.lit(0.0)) / F.log2(F.lit(float(max(classes, 2))))).otherwise(0.0)
    return choices.groupBy(*cell).agg(value.alias("s_tau"))


def metric_rows(samples: DataFrame, cell: list[str], *, prompts: DataFrame | None = None, responses: DataFrame | None = None, matrix: DataFrame | None = None, lengths: DataFrame | None = None, spec: DataFrame | None = None, bootstrap: int = 0, seed: int = 42, encoder: str | None = None) -> DataFrame:
    """The wide row of each cell: all metrics, null where their facts are not given.

    ``prompts`` and ``responses`` have ``embedding`` (the latter ``par`` too), ``matrix`` and ``lengths`` are as for
    :func:`posix`, ``spec`` has ``m0, m_valid, spec_level, target_idx``. The curve is clamped at ``log2(n + 1)``; its intervals
    come from ``bootstrap`` resamples of paraphrases.
    """
    from .bootstrap import curve_intervals

    counts = written(cluster_counts(samples.where("cluster is not null"), cell), "counts")  # three metrics read it
    scored = graded(samples, cell)
    facts_ = facts(scored, cell)
    cap = F.log2(F.col("n") + F.lit(1.0))
    clamped = F.transform(curve(), lambda x: F.least(x, cap))
    given = facts_.select(*cell, *input_columns(), clamped.alias("curve"), F.round(F.col("trials") / F.col("n"), 6).alias("n_samples_per_prompt"))
    parts = [given, output_metrics(counts, cell), consistency(counts, cell), variation_ratio(counts, cell)]
    parts.append(ess_in(prompts, cell) if prompts is not None else None)
    parts.append(rho_u(responses, cell).select(*cell, "rho_u") if responses is not None else None)
    parts.append(posix(matrix, lengths, cell) if matrix is not None else None)
    parts.append(spec.select(*cell, "m0", "m_valid", "spec_level", "target_idx", E.fi_spec(F.col("m0"), F.col("m_valid")).alias("fi_spec")) if spec is not None else None)
    parts.append(curve_intervals(scored, cell, bootstrap, seed) if bootstrap else None)
    absent = (
        {"ess_in": "double", "rho_u": "double", "posix_psi": "double", "m0": "int", "m_valid": "int", "spec_level": "int", "target_idx": "int", "fi_spec": "double"}
        | {"ci_low": "array<double>", "ci_high": "array<double>"}
    )
    out = parts[0]
    for part in parts[1:]:
        if part is not None:
            out = out.join(part, cell, "left")
    for name, kind in absent.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    # a cell without clusters has one of entropy 0
    zero = {"h_sem_mean": 0.0, "h_sem_var": 0.0, "a_q": 1, "fi_out_mean": 0.0, "fi_out_var": 0.0, "s_tau_mean": 0.0, "consistency": 1.0}
    return out.fillna(zero).withColumn("encoder_label", F.lit(encoder))


def kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two binary raters over rows that both rated: ``n, p_obs, p_exp, kappa``."""
    rated = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    seen = rated.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("p_obs"), (x * y + (1 - x) * (1 - y)).alias("p_exp"))
    certain = F.abs(1 - F.col("p_exp")) < 1e-12
    return seen.withColumn("kappa", F.when(certain, 1.0).otherwise((F.col("p_obs") - F.col("p_exp")) / F.when(~certain, 1 - F.col("p_exp"))))


def best_paraphrase(rows: DataFrame, cell: list[str]) -> DataFrame:
    """The paraphrase with the highest ``f``; ties go to the shortest ``text``, then to the first in order."""
    rank = F.struct((-F.col("f")).alias("f"), F.length("text").alias("l"), F.col("text").alias("t"))
    return rows.groupBy(*cell).agg(F.min_by(F.struct("par", "embedding"), rank).alias("best")).select(*cell, F.col("best.par").alias("best_par"), F.col("best.embedding").alias("best_embedding"))


def distance_correlation(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Rank correlation of scores and distances to the best paraphrase over the others; null for fewer than three or no variance."""
    others = rows.join(best_paraphrase(rows, cell), cell).where("par <> best_par")
    far = others.select(*cell, "f", E.distance_to(F.col("embedding"), F.col("best_embedding")).alias("dist"))
    return rank_correlation(far, "f", "dist", cell, "rho", least=2)
