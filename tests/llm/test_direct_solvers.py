"""The two classifiers against solvers that go another way."""

import numpy as np

from helixloom.llm import langid, quality


def test_ridge_from_partition_sums_is_that_of_all_rows_at_once(spark):
    rng, k = np.random.default_rng(3), len(quality.STATISTICS)
    stats = rng.normal(size=(400, k)) * rng.uniform(0.1, 9, k)
    label = (stats[:, 0] + stats[:, 1] ** 2 > 1).astype(float)
    rows = spark.createDataFrame([(s.tolist(), float(y)) for s, y in zip(stats, label, strict=True)], "stats array<double>, label double").repartition(5)
    model = quality.fit(rows, rows.filter("false"), features=64, ridge=1e-2)
    z = np.clip((stats - stats.mean(axis=0)) / stats.std(axis=0), -5, 5)
    phi = np.concatenate([np.sqrt(2 / 64) * np.cos(z @ model.project + model.phase), np.ones((400, 1))], axis=1)
    penalty = np.sqrt(np.r_[np.full(64, 1e-2 * 400 / 64), 1e-9])
    direct = np.linalg.lstsq(np.concatenate([phi, np.diag(penalty)]), np.concatenate([label, np.zeros(65)]), rcond=None)[0]
    assert np.allclose(model.raw(stats), phi @ direct, atol=1e-6)


def test_fourier_features_are_near_a_gaussian_kernel(spark):
    rng, k = np.random.default_rng(5), len(quality.STATISTICS)
    stats = rng.normal(size=(40, k))
    rows = spark.createDataFrame([(s.tolist(), 1.0) for s in stats], "stats array<double>, label double")
    model = quality.fit(rows, rows.filter("false"), features=4096)
    z = np.clip((stats - model.mean) / model.scale, -5, 5)
    phi = model.lift(stats)[:, :-1]
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / k)
    assert np.abs(phi @ phi.T - kernel).max() < 0.1


def test_isotonic_is_the_greatest_of_the_least_means():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        at, count = np.sort(rng.uniform(size=n)), rng.integers(1, 9, n).astype(float)
        total = count * rng.uniform(size=n)
        mean = lambda j, i, total=total, count=count: total[j : i + 1].sum() / count[j : i + 1].sum()
        want = [max(min(mean(j, i) for i in range(x, n)) for j in range(x + 1)) for x in range(n)]
        assert np.allclose(np.interp(at, *quality.isotonic(at, total, count)), want)


def objective(w, b, x, y, weight, cost):
    return 0.5 * w @ w + cost * (weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()


def newton(x, y, weight, cost):
    """Squared hinge by Newton steps over the rows that are inside the margin, in double precision."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(100):
        inside = y * (x @ w + b) < 1
        z = np.concatenate([x[inside], np.ones((inside.sum(), 1))], axis=1)
        system = 2 * cost * (z * weight[inside, None]).T @ z + np.diag(np.r_[np.ones(x.shape[1]), 1e-12])
        goal = np.linalg.solve(system, 2 * cost * z.T @ (weight[inside] * y[inside]))
        step = 1.0
        while step > 1e-6 and objective(w + step * (goal[:-1] - w), b + step * (goal[-1] - b), x, y, weight, cost) > objective(w, b, x, y, weight, cost):
            step /= 2
        w, b = w + step * (goal[:-1] - w), b + step * (goal[-1] - b)
    return w, b


def test_support_vector_machine_reaches_the_optimum():
    rng = np.random.default_rng(7)
    for share, noise in ((0.5, 0.3), (0.1, 1.0)):
        y = np.where(rng.random(300) < share, 1.0, -1.0)
        x = np.abs(rng.normal(size=(300, 12))) * 0.2 + np.outer(y, rng.normal(size=12)) * 0.05 + noise * 0.1 * rng.normal(size=(300, 12))
        weight = np.where(y > 0, 300 / (2 * (y > 0).sum()), 300 / (2 * (y < 0).sum()))
        w, b = langid.fit_svm(x.astype(np.float32), y.astype(np.float32))
        best, shift = newton(x, y, weight, 4.0)
        least = objective(best, shift, x, y, weight, 4.0)
        assert least * (1 - 1e-6) <= objective(w.astype(float), b, x, y, weight, 4.0) <= 1.02 * least
        assert ((x @ w + b > 0) == (x @ best + shift > 0)).mean() > 0.98
