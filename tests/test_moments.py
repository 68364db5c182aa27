import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcast.operators import moments as m
from stationcast.plans import least_squares as ls
from stationcast.session import scratch_path


@pytest.fixture(scope="module")
def points(spark):
    """Dependent and constant columns, large means, a third of the rows in one group, null keys and values."""
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=(n, 4)) * [1, 1e3, 0.01, 1] + [0, 2e7, 0, 7]
    x = np.column_stack([x, 2 * x[:, 0] + x[:, 3], np.full(n, 3.0), x[:, 1]])
    y = x[:, :4] @ [1, 2, 3, 4] + rng.normal(size=n)
    keys = [None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 400}" for i in range(n)]
    rows = [(k, i % 6 if i % 7 else None, *v.tolist(), float(t)) for i, (k, v, t) in enumerate(zip(keys, x, y, strict=True))]
    rows += [("s1", 0, None, *[1.0] * 6, 1.0), ("s1", 0, float("nan"), *[1.0] * 6, 1.0), ("s1", 0, *[1.0] * 7, None), ("lost", 0, *[None] * 7, None)]
    names = [f"x{i}" for i in range(7)]
    df = spark.createDataFrame(rows, f"station string, block int, {', '.join(n + ' double' for n in names)}, label double").repartition(6)
    return df.select("station", "block", "label", F.array(*names).alias("features")), x, y, keys


def exact(x, y):
    slopes = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-9)[0]
    return slopes, y.mean() - x.mean(axis=0) @ slopes


def test_minimum_norm_solution(points):
    df, x, y, _ = points
    fitted = ls.LeastSquares().fit(df)
    slopes, intercept = exact(x, y)
    assert fitted.rank == 4
    assert np.allclose(fitted.coefficients, slopes, rtol=1e-5, atol=1e-9)
    residual = fitted.transform(df).filter("label is not null and not isnan(prediction)").select(
        F.avg(F.col("prediction") - F.col("label")), F.avg((F.col("prediction") - F.col("label")) * F.col("features")[0])
    )
    assert all(abs(v) < 1e-6 for v in residual.first())


def test_moments_of_groups(points):
    df, x, y, keys = points
    values = F.concat("features", F.array("label"))
    found = {r.station: r for r in m.moments(df, values, ["station"]).collect()}
    whole = np.column_stack([x, y])
    assert set(found) == set(keys)
    for key in ("hot", "s1", None):
        own = whole[[k == key for k in keys]]
        assert found[key].n == len(own)
        assert np.allclose(found[key].means, own.mean(axis=0))
        apart = own - own.mean(axis=0)
        assert np.allclose(m.matrix_of(np.array(found[key].co)), apart.T @ apart, rtol=1e-9, atol=1e-6)
    n, mean, _ = m.merged(list(found.values()))
    assert n == len(whole) and np.allclose(mean, whole.mean(axis=0))


def test_many_groups_in_small_pieces(points, monkeypatch):
    df, _, _, keys = points
    monkeypatch.setattr(m, "HELD", 3)
    values = F.array("label")
    out = m.moments(df, values, ["station", "block"])
    plain = df.filter("label is not null").groupBy("station", "block").agg(F.count("label").alias("n"), F.avg("label").alias("mean"))
    same = (F.col("a.station").eqNullSafe(F.col("b.station"))) & (F.col("a.block").eqNullSafe(F.col("b.block")))
    both = out.alias("a").join(plain.alias("b"), same, "full")
    assert out.count() == plain.count()
    assert both.filter("a.n is null or b.n is null or a.n <> b.n or abs(a.means[0] - b.mean) > 1e-6 * abs(b.mean)").count() == 0


def test_folds_from_one_scan(points):
    df, x, y, _ = points
    model, folds = ls.LeastSquares().fit_blocks(df)
    assert np.allclose(model.coefficients, exact(x, y)[0], rtol=1e-5, atol=1e-9)
    block = np.array([i % 6 if i % 7 else -1 for i in range(len(y))])
    errors = {r.fold: r.fold_mae for r in ls.LeastSquares().fold_errors(df, folds).collect()}
    assert set(errors) == {1, 2, 3, 4, 5}
    for k, error in errors.items():
        before = (block >= 0) & (block < k)
        slopes, intercept = exact(x[before], y[before])
        assert np.isclose(error, np.abs(x[block == k] @ slopes + intercept - y[block == k]).mean(), rtol=1e-6)


def test_model_for_each_group(points):
    df, x, y, keys = points
    models = ls.group_models(df)
    found = {r.station: r for r in models.collect()}
    assert set(found) == {k for k in keys if k}
    for key in ("hot", "s1"):
        own = np.array([k == key for k in keys])
        slopes, intercept = exact(x[own], y[own])
        centered = x[own] - x[own].mean(axis=0)
        assert np.allclose(centered @ found[key].weights, centered @ slopes, rtol=1e-4, atol=1e-5)
    scored = ls.score_groups(df, models)
    assert scored.filter("station is null and prediction is not null").count() == 0
    assert scored.count() == df.count()


def test_degenerate_tables(spark):
    one = spark.createDataFrame([([5.0], 2.0)], "features array<double>, label double")
    fitted = ls.LeastSquares().fit(one)
    assert fitted.coefficients == [0.0] and fitted.intercept == 2.0 and fitted.rank == 0
    with pytest.raises(ValueError):
        ls.LeastSquares().fit(one.limit(0))
    assert ls.group_models(one.withColumn("station", F.lit("a")).limit(0)).count() == 0


def test_saved_rule(spark, points):
    df, *_ = points
    fitted = ls.LeastSquares().fit(df)
    path = scratch_path(spark, "rule")
    fitted.write().save(path)
    again = ls.LeastSquaresModel.load(path)
    assert again.coefficients == fitted.coefficients and again.intercept == fitted.intercept and again.rank == fitted.rank


def test_correlations_of_many_columns(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 200)) + rng.normal(size=(500, 1)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5], x[:, 6] = 3.3, np.nan
    x[:250, 7], x[250:, 7] = np.nan, 1.1
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])
    df = spark.createDataFrame(frame).repartition(5)
    found = m.pair_correlations(df, frame.columns).toPandas()
    assert len(found) == 200 * 200
    wide = found.pivot(index="column_a", columns="column_b", values="correlation").loc[frame.columns, frame.columns].to_numpy()
    counts = found.pivot(index="column_a", columns="column_b", values="n").loc[frame.columns, frame.columns].to_numpy()
    expected = frame.corr(min_periods=1).to_numpy()
    expected[[5, 6, 7]] = expected[:, [5, 6, 7]] = np.nan
    known = (~np.isnan(x)).astype(int)
    assert np.array_equal(counts, known.T @ known)
    assert np.allclose(wide, expected, atol=1e-8, equal_nan=True)
    empty = m.pair_correlations(df.limit(0), ["c0", "c1"]).collect()
    assert len(empty) == 4 and all(r.correlation is None and r.n == 0 for r in empty)
