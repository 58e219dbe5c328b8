"""Distribution functions against hand-derived / published values (FIXTURES.md section 3)."""

import math

import pytest

from sondage.functions import pvalues as PV


def test_mcnemar_exact_m1():
    assert round(PV.binom_two_sided_half(2, 12), 4) == 0.0386
    assert round(((10 - 2) ** 2) / 12, 4) == 5.3333


def test_mcnemar_chi2_m2():
    assert round(PV.chi2_sf_df1(5.0), 4) == 0.0253


def test_fisher_m3():
    assert PV.fisher_two_sided(1, 9, 11, 3) == pytest.approx(0.0027594562, abs=1e-10)


def test_fisher_symmetric_table_is_one():
    assert PV.fisher_two_sided(5, 5, 5, 5) == pytest.approx(1.0)


def test_norm_ppf_roundtrip():
    for p in (1e-12, 0.001, 0.025, 0.3, 0.5, 0.77, 0.975, 0.999999):
        assert PV.norm_cdf(PV.norm_ppf(p)) == pytest.approx(p, rel=1e-12, abs=1e-15)
    assert PV.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)


def test_t_distribution():
    # two-sided p of t = 2 with 10 df (tables: 0.0733880347707)
    assert PV.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert PV.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_welch_m17():
    a, b = [8.0, 9.0, 7.0], [5.0, 6.0]
    m1, m2 = sum(a) / 3, sum(b) / 2
    v1 = sum((x - m1) ** 2 for x in a) / 2
    v2 = sum((x - m2) ** 2 for x in b) / 1
    se2 = v1 / 3 + v2 / 2
    t = (m1 - m2) / math.sqrt(se2)
    df = se2 ** 2 / ((v1 / 3) ** 2 / 2 + (v2 / 2) ** 2 / 1)
    assert round(t, 6) == 3.273268 and round(df, 6) == 2.882353


def test_mwu_exact_distribution():
    # n1 = n2 = 3, U ranges 0..9 with 20 equally likely arrangements
    assert PV.mwu_exact_sf(9, 3, 3) == pytest.approx(1 / 20)
    assert PV.mwu_exact_sf(0, 3, 3) == pytest.approx(1.0)
    assert PV.mwu_exact_sf(8, 3, 3) == pytest.approx(2 / 20)


def test_signrank_exact():
    # n = 5: P(T <= 0) = 1/32, P(T <= 1) = 2/32
    assert PV.signrank_exact_cdf(0, 5) == pytest.approx(1 / 32)
    assert PV.signrank_exact_cdf(1, 5) == pytest.approx(2 / 32)


def test_betainc_edges():
    assert PV.betainc(2.0, 3.0, 0.0) == 0.0
    assert PV.betainc(2.0, 3.0, 1.0) == 1.0
    # I_0.5(a, a) = 0.5
    assert PV.betainc(4.5, 4.5, 0.5) == pytest.approx(0.5, abs=1e-14)


def test_mwu_exact_matches_enumeration():
    import itertools

    def brute(u, n1, n2):
        tot = cnt = 0
        for pos in itertools.combinations(range(n1 + n2), n1):
            s, U, ys = set(pos), 0, 0
            for r in range(n1 + n2):
                if r in s:
                    U += ys
                else:
                    ys += 1
            tot += 1
            cnt += U >= u
        return cnt / tot

    for n1, n2 in [(2, 5), (5, 2), (4, 6), (1, 7), (8, 3)]:
        for u in range(0, n1 * n2 + 2):
            assert PV.mwu_exact_sf(u, n1, n2) == pytest.approx(brute(u, n1, n2), abs=1e-12)


def test_mwu_exact_large_other_side_is_fast():
    import time
    t = time.time()
    assert PV.mwu_exact_sf(8 * 100000 / 2, 8, 100000) == pytest.approx(0.5, abs=1e-3)
    assert time.time() - t < 5


def test_fisher_vectorised_matches_loop_and_scales():
    import random
    import time
    rnd = random.Random(5)
    for _ in range(200):
        a, b, c, d = (rnd.randint(0, 40) for _ in range(4))
        if a + b + c + d:
            assert PV.fisher_two_sided(a, b, c, d) == pytest.approx(PV._fisher_loop(a, b, c, d), abs=1e-12)
    t = time.time()
    PV.fisher_two_sided(400_000_000, 410_000_000, 390_000_000, 400_000_000)
    assert time.time() - t < 5


def test_binomial_exact_matches_integers_and_scales():
    import math
    import time
    for n in range(1, 80):
        for k in range(0, n + 1):
            kk = min(k, n - k)
            exp = min(1.0, 2 * sum(math.comb(n, i) for i in range(kk + 1)) / 2 ** n)
            assert PV.binom_two_sided_half(k, n) == pytest.approx(exp, abs=1e-12)
    t = time.time()
    assert PV.binom_two_sided_half(499_990_000, 1_000_000_000) == pytest.approx(0.5271104, abs=1e-6)
    assert time.time() - t < 5


def test_t_large_df_tends_to_normal():
    for t in (0.5, 2.0, 5.0):
        for df in (1e8, 1e12):
            assert PV.t_two_sided(t, df) == pytest.approx(2 * PV.norm_sf(t), rel=1e-6)
