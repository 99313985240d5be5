"""The robust estimate where a third of a source is junk."""

import numpy as np

from lodestar.llm import quality_rules


def test_a_third_of_equal_junk_is_far(spark):
    rng = np.random.default_rng(8)
    floors = np.array(list(quality_rules.VECTOR.values()))
    good = rng.normal(0, 1, (400, len(floors))) * floors
    for spread in (0,):
        junk = 20 * floors + rng.normal(0, spread, (200, len(floors))) * floors
        x = np.concatenate([good, junk])
        rows = spark.createDataFrame([("en", "a", r.tolist()) for r in x], "lang string, source string, x array<double>")
        e = quality_rules.estimates(rows).first()
        precision = np.zeros((len(floors),) * 2)
        precision[np.triu_indices(len(floors))] = e.precision
        precision = (precision + precision.T) / 2
        d = np.einsum("ni,ij,nj->n", x - e.mean, precision, x - e.mean)
        assert d[400:].min() > quality_rules.CUTOFF and d[:400].max() < quality_rules.CUTOFF


def fast_mcd(x, starts, rng):
    """The best determinant that steps over exact halves reach, and the squared distances under its reweighted estimate."""
    n, p = x.shape
    h, best = n // 2, (np.inf, None)

    def inverse(cov):
        packed, size = quality_rules._precision(cov)
        full = np.zeros((p, p))
        full[np.triu_indices(p)] = packed
        return (full + full.T) / 2, size

    for _ in range(starts):
        some = rng.choice(n, p + 1, replace=False)
        for _ in range(60):
            mean = x[some].mean(0)
            precision, size = inverse(np.cov(x[some].T, bias=True) * (quality_rules._scale(0.5) if len(some) == h else 1))
            d = np.einsum("ni,ij,nj->n", x - mean, precision, x - mean)
            nearest = np.argsort(d, kind="stable")[:h]
            if set(nearest) == set(some):
                break
            some = nearest
        if size < best[0]:
            best = (size, d)
    near = x[best[1] <= quality_rules._chi2_quantile(quality_rules.INSIDE, p)]
    precision, _ = inverse(np.cov(near.T, bias=True) * quality_rules._scale(quality_rules.INSIDE))
    return best[0], np.einsum("ni,ij,nj->n", x - near.mean(0), precision, x - near.mean(0))


def test_verdicts_match_a_search_over_subsets(spark):
    """Correlated groups with junk of two kinds: the verdicts of the best of 60 random starts, but for rows at the cutoff."""
    rng = np.random.default_rng(9)
    floors = np.array(list(quality_rules.VECTOR.values()))
    p, groups = len(floors), {}
    for k, source in enumerate("abc"):
        skew = np.eye(p) + 0.4 * rng.normal(0, 1, (p, p))
        good = rng.normal(0, 1.5, (1500, p)) @ skew * floors + k * floors
        junk = [good[:250] + 12 * floors * rng.choice([-1, 1], p), good[:60] * 0 + 30 * floors * rng.random(p)]
        groups[source] = np.concatenate([good, *junk])
    rows = spark.createDataFrame([("en", s, r.tolist()) for s, x in groups.items() for r in x], "lang string, source string, x array<double>")
    found = {e.source: e for e in quality_rules.estimates(rows).where("lang is not null").collect()}
    for s, x in groups.items():
        precision = np.zeros((p, p))
        precision[np.triu_indices(p)] = found[s].precision
        precision = (precision + precision.T) / 2
        d = np.einsum("ni,ij,nj->n", x - found[s].mean, precision, x - found[s].mean)
        _, exact = fast_mcd(x, 60, rng)
        clear = np.abs(np.log(exact / quality_rules.CUTOFF)) > 0.25
        assert clear.mean() > 0.95 and ((d > quality_rules.CUTOFF) == (exact > quality_rules.CUTOFF))[clear].all()
        assert (d[1500:] > quality_rules.CUTOFF).mean() > 0.9


def test_few_texts_reject_next_to_nothing(spark):
    floors = np.array(list(quality_rules.VECTOR.values()))
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (12, len(floors))) * floors * 3
    rows = spark.createDataFrame([("en", None, r.tolist()) for r in x], "lang string, source string, x array<double>")
    e = quality_rules.estimates(rows).first()
    precision = np.zeros((len(floors),) * 2)
    precision[np.triu_indices(len(floors))] = e.precision
    precision = (precision + precision.T) / 2
    assert np.einsum("ni,ij,nj->n", x - e.mean, precision, x - e.mean).max() < quality_rules.CUTOFF


def test_distance_is_made_once_for_all_sums(spark):
    """Every task of the last estimate binds its plan anew: with the distance in each of the sums, that took hundreds of MB."""
    p = len(quality_rules.VECTOR)
    rows = spark.createDataFrame([(2, "en", "a", [float(i)] * p) for i in range(4)], "level int, lang string, source string, x array<double>")
    found = spark.createDataFrame([(2, "en", "a", 4, [1.0] * p, [0.01] * (p * (p + 1) // 2))], f"{quality_rules._KEYS}, n long, mean array<double>, precision array<double>")
    kept = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "100000")
    try:
        moments = quality_rules._reweighted(rows, found)
        plan = moments._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(kept, before)
    assert plan.count("precision#") < 2 * p * (p + 1)
    assert "SortAggregate" not in plan
    r = moments.first()
    assert (r.n, r.m, list(r.mean)) == (4, 4, [1.5] * p)
