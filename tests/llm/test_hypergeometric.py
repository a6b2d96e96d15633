"""The draw of the communication matrix against exact probabilities, at all sizes."""

import math
import random
import time
from collections import Counter
from fractions import Fraction

import pytest

from foliograph.llm import sharding as S


@pytest.mark.parametrize("good, bad, draws", [(30, 70, 20), (5, 3, 7), (1, 1, 1), (2000, 9000, 4000), (50_000, 120_000, 61_000)])
def test_probabilities_are_exact(good, bad, draws):
    low, high = max(0, draws - bad), min(good, draws)
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    for x in {low, high, *range(max(low, mode - 3), min(high, mode + 3) + 1)}:
        want = Fraction(math.comb(good, x) * math.comb(bad, draws - x), math.comb(good + bad, draws))
        if float(want) > 1e-300:
            assert S.log_hypergeometric(x, good, bad, draws) == pytest.approx(math.log(want), rel=1e-11, abs=1e-11)


@pytest.mark.parametrize("total", [10**11, 10**12, 10**13])
def test_mass_of_large_populations(total):
    """The probabilities around the mode sum to one."""
    good, draws = total // 8, 4 * 10**6
    middle, spread = draws // 8, math.sqrt(draws * 7 / 64)
    mass = math.fsum(math.exp(S.log_hypergeometric(x, good, total - good, draws)) for x in range(middle - int(7 * spread), middle + int(7 * spread) + 1))
    assert mass == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("good, bad, draws", [(10**12 // 8, 7 * 10**12 // 8, 10**11), (7 * 10**11, 3 * 10**11, 6 * 10**11), (10**13, 10**13, 10**7)])
def test_large_draws(good, bad, draws):
    r, total, n = random.Random(1), good + bad, 4000
    began = time.perf_counter()
    x = [S.hypergeometric(r, good, bad, draws) for _ in range(n)]
    assert time.perf_counter() - began < 5
    mean, var = draws * good / total, draws * (good / total) * (bad / total) * (total - draws) / (total - 1)
    z = [(v - mean) / math.sqrt(var) for v in x]
    assert abs(sum(z) / n) < 4 / math.sqrt(n) and abs(sum(v * v for v in z) / n - 1) < 4 * math.sqrt(2 / n)
    for cut, share in ((-1.0, 0.15866), (0.5, 0.69146), (2.0, 0.97725)):
        assert abs(sum(v <= cut for v in z) / n - share) < 4 * math.sqrt(share * (1 - share) / n)


def test_ratio_of_uniforms_follows_the_law():
    """Wide enough for the rejection, narrow enough to count: chi-squared over all values that occur often."""
    r, good, bad, draws, n = random.Random(2), 9000, 12_000, 10_000, 60_000
    seen = Counter(S.hypergeometric(r, good, bad, draws) for _ in range(n))
    want = {x: n * math.exp(S.log_hypergeometric(x, good, bad, draws)) for x in seen}
    often = [x for x in want if want[x] >= 20]
    chi = sum((seen[x] - want[x]) ** 2 / want[x] for x in often)
    assert abs(chi - len(often)) < 5 * math.sqrt(2 * len(often))
