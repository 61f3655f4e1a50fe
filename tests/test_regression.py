import time

import numpy as np

from tessella.operators import regression


def test_leave_one_out_errors_are_those_of_refits():
    rng = np.random.default_rng(3)
    for n in (5, 40):
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1]
        y = x @ [1.0, -0.2, 3.0] + rng.normal(size=n)
        errors = 0.0
        for i in range(n):
            others = np.arange(n) != i
            beta, intercept = regression.ridge(x[others], y[others], 1.0)
            errors += (y[i] - x[i] @ beta - intercept) ** 2
        assert np.isclose(regression.loo_r2(x, y), 1 - errors / ((y - y.mean()) ** 2).sum(), rtol=1e-9)


def test_leave_one_out_is_linear_in_the_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200_000, 2))
    begun = time.monotonic()
    assert regression.loo_r2(x, x.sum(axis=1)) > 0.99
    assert time.monotonic() - begun < 20
