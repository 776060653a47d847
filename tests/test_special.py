"""Distribution tails against published values (no scipy here)."""
import math

import pytest

from segment_lab.functions.special import binom_cdf, f_sf


@pytest.mark.parametrize("f,d1,d2,p", [
    (4.26, 2, 9, 0.05),      # F table, alpha = .05
    (3.10, 3, 20, 0.05),
    (10.04, 1, 10, 0.01),    # alpha = .01
    (7.56, 2, 10, 0.01),
    (2.69, 4, 30, 0.05),
])
def test_f_tail_matches_tables(f, d1, d2, p):
    assert f_sf(f, d1, d2) == pytest.approx(p, abs=1e-3)


def test_f_tail_closed_form_for_two_numerator_df():
    # with d1 = 2: p = (1 + 2F/d2)^(-d2/2)
    for f, d2 in [(0.5, 7), (3.0, 40), (216.0, 396)]:
        assert f_sf(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-9)


def test_binomial_cdf():
    assert binom_cdf(0, 10) == pytest.approx(0.5 ** 10)
    assert binom_cdf(5, 10) == pytest.approx(sum(math.comb(10, i) for i in range(6)) / 1024)
    assert binom_cdf(10, 10) == pytest.approx(1.0)
    # large n stays finite and symmetric
    assert binom_cdf(500, 1000) + binom_cdf(499, 1000) == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize("d2", [1e4, 1e6, 1e8, 1e10, 1e12, 1e14])
def test_f_tail_at_large_counts(d2):
    from segment_lab.functions.special import betainc
    for f in (0.3, 1.0, 2.7, 9.0, 40.0):
        want = math.exp(-0.5 * d2 * math.log1p(2 * f / d2))
        whole = d2 + 2 * f
        assert betainc(d2 / 2, 1.0, d2 / whole, 2 * f / whole) == pytest.approx(want, rel=1e-9)
        # four numerator degrees: p = (1 + a) exp(-a) in the limit, with a = 2 f, to first order in 1 / d2
        assert f_sf(f, 4, d2) == pytest.approx((1 + 2 * f) * math.exp(-2 * f), rel=2 * (1 + 4 * f * f) * 10 / d2 + 1e-9)


def exact_half(k, n):
    """Sum of the binomial terms from the middle, with exact integers."""
    from fractions import Fraction
    term = Fraction(math.comb(n, k), 2 ** n)
    total = Fraction(0)
    j = k
    while j >= 0 and term:
        total += term
        if term < total / 10 ** 14:
            break
        term = term * j / (n - j + 1)
        j -= 1
    return float(total)


@pytest.mark.parametrize("n", [10_000, 20_001])
def test_binomial_tail_against_exact_sums(n):
    for z in (0, 1, 3, 6):
        k = n // 2 - int(z * math.sqrt(n) / 2)
        assert binom_cdf(k, n) == pytest.approx(exact_half(k, n), rel=1e-9)


def test_binomial_series_meets_the_fraction(monkeypatch):
    import segment_lab.functions.special as S
    for n in (10 ** 8, 4 * 10 ** 8 + 1):
        for z in (0.0, 0.5, 2.0, 5.0):
            k = n // 2 - int(z * math.sqrt(n) / 2)
            monkeypatch.setattr(S, "_LARGE_N", 1e8)
            series = binom_cdf(k, n)
            monkeypatch.setattr(S, "_LARGE_N", 1e99)
            assert series == pytest.approx(binom_cdf(k, n), rel=1e-9)
    monkeypatch.setattr(S, "_LARGE_N", 1e8)
    for n in (10 ** 12, 10 ** 14):  # the middle of an even count: half of all, plus half of the central term
        central = math.exp(S._stirling_error(n) - 2 * S._stirling_error(n / 2)) * math.sqrt(2 / (math.pi * n))
        assert binom_cdf(n // 2, n) == pytest.approx(0.5 + central / 2, rel=1e-12)


def test_no_silent_result_without_convergence(monkeypatch):
    import segment_lab.functions.special as S
    monkeypatch.setattr(S, "_MAX_STEPS", 3)
    with pytest.raises(ArithmeticError):
        S.betainc(5e5, 5e5, 0.4999)
