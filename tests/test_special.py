"""Tail probabilities against closed forms and tabulated values."""

import math

import numpy as np

from genemill.functions import special as S


def test_t_tail_closed_forms():
    t = np.array([0.0, 0.5, 1.0, 3.0, 40.0])
    assert np.allclose(S.t_two_sided(t, 1.0), 1 - 2 / np.pi * np.arctan(t), atol=1e-13)
    assert np.allclose(S.t_two_sided(t, 2.0), 1 - t / np.sqrt(2 + t * t), atol=1e-13)
    assert abs(S.t_two_sided(np.array([2.228138852]), 10.0)[0] - 0.05) < 1e-9


def test_f_and_chi2_closed_forms():
    f = np.array([0.1, 1.0, 5.0])
    assert np.allclose(S.f_upper(f, 2.0, 30.0), (1 + 2 * f / 30) ** -15, atol=1e-13)
    x = np.array([0.2, 2.0, 30.0])
    assert np.allclose(S.chi2_upper(x, 2.0), np.exp(-x / 2), atol=1e-14)
    assert np.allclose(S.chi2_upper(x, 4.0), np.exp(-x / 2) * (1 + x / 2), atol=1e-14)
    assert np.allclose(S.chi2_upper(x, 1.0), [math.erfc(math.sqrt(v / 2)) for v in x], atol=1e-14)


def test_normal_and_hypergeometric():
    assert abs(S.normal_quantile([0.975])[0] - 1.959963984540054) < 1e-9
    total = sum(math.comb(5, j) * math.comb(15, 6 - j) for j in range(3, 6)) / math.comb(20, 6)
    assert abs(S.hypergeom_upper([3], [20], [5], [6])[0] - total) < 1e-12


def test_mann_whitney_exact_by_enumeration():
    from itertools import combinations

    n1, n2 = 3, 4
    us = []
    for pick in combinations(range(1, n1 + n2 + 1), n1):
        us.append(sum(pick) - n1 * (n1 + 1) / 2)
    us = np.array(us)
    for u in range(0, n1 * n2 + 1):
        big = max(u, n1 * n2 - u)
        expected = min(1.0, 2 * (us >= big).mean())
        assert abs(S.mann_whitney_exact([u], [n1], [n2])[0] - expected) < 1e-12
