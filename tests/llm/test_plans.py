"""Packing plans where no filling is nearly full."""

from collections import Counter

from tellurion.llm import plans


def test_the_program_is_solved_where_fillings_stay_short():
    histogram = {1030: 600, 530: 600, 520: 600, 490: 1200}
    plan = plans.configuration_lp(histogram, 2048)
    held = Counter()
    for many, fill in plan:
        assert sum(n * k for n, k in fill) <= 2048
        for n, k in fill:
            held[n] += many * k
    assert held == histogram
    assert plans.sequences(plan) == 900
    assert sum(many for many, _ in plans.best_fit_decreasing(histogram, 2048)) == 1100
