"""The network against finite differences and against a single-process run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orfloom.operators import network as m


def data(n=300, classes=3, seed=0):
    r = np.random.default_rng(seed)
    y = r.choice(classes, n, p=[0.6, 0.3, 0.1][:classes] if classes == 3 else None)
    return r.normal(size=(n, 4)) + 2 * y[:, None] * [1, 0, -1, 0.5], y


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, embedding array<double>, label int")


def test_gradients_are_finite_differences():
    x, y = data(20)
    params, w = m.start([4, 5, 3, 3], 1), np.array([0.5, 1.0, 3.0])
    loss, grads = m.loss_sums(params, x, y, w)
    p = m.outputs(params, x)
    assert loss == pytest.approx(-(w[y] * np.log(p[np.arange(20), y])).sum())
    for p, g in zip(params, grads):
        for at in np.ndindex(p.shape):
            p[at] += 1e-6
            up = m.loss_sums(params, x, y, w)[0]
            p[at] -= 2e-6
            down = m.loss_sums(params, x, y, w)[0]
            p[at] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-4)


@pytest.mark.parametrize("batch_rows,weights", [(10**6, "balanced"), (100, None), (64, [1.0, 2.0, 0.5])])
def test_losses_and_weights_are_those_of_one_process(spark, monkeypatch, batch_rows, weights):
    monkeypatch.setattr(m, "BLOCK_ROWS", 16)
    x, y = data()
    df = table(spark, x, y).repartition(3)
    net, losses = m.fit_network(df, [4, 6, 3], epochs=8, batch_rows=batch_rows, weights=weights)
    batches = -(-len(x) // batch_rows)
    batch = {r.id: r.b for r in df.select("id", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(batches)).alias("b")).collect()}
    z = (x - x.mean(0)) / x.std(0)
    counts = np.bincount(y, minlength=3)
    w = len(y) / (counts * 3) if weights == "balanced" else np.ones(3) if weights is None else np.array(weights)
    params, adam, want = m.start([4, 6, 3], 42), m.Adam(0.01), []
    for _ in range(8):
        total = 0.0
        for b in range(batches):
            own = np.array([i for i in range(len(x)) if batch[i] == b])
            loss, grads = m.loss_sums(params, z[own], y[own], w)
            total += loss
            adam.step(params, [g / len(own) for g in grads])
        want.append(total / len(x))
    assert losses == pytest.approx(want) and losses[-1] < losses[0]
    for a, b in zip(net.params, params):
        assert np.allclose(a, b, atol=1e-9)


def test_predictions_saving_and_odd_rows(spark, tmp_path):
    x, y = data()
    df = table(spark, x, y)
    net, _ = m.fit_network(df, [4, 16, 3], epochs=60, rate=0.02)
    net.save(spark, str(tmp_path / "net"))
    again = m.Network.load(spark, str(tmp_path / "net"))
    odd = df.select("id", "label", F.when(F.col("id") != 7, F.col("embedding")).alias("embedding"), F.lit(1).alias("_v2"))
    got = {r.id: r for r in again.predict(odd).collect()}
    p = m.outputs(net.params, (x - x.mean(0)) / x.std(0))
    assert len(got) == 300 and got[7].model_label is None and got[7].model_output_0 is None
    assert all(got[i].model_label == p[i].argmax() and abs(got[i].model_output_1 - p[i, 1]) < 1e-9 for i in range(300) if i != 7)
    assert (p.argmax(1) == y).mean() > 0.85
    rare = y == 2
    assert (p.argmax(1)[rare] == 2).mean() > 0.8  # a class of a tenth of the rows is not given up
    with pytest.raises(ValueError):
        m.fit_network(df.where("id < 0"), [4, 3])
    with pytest.raises(ValueError):
        m.fit_network(df, [4, 2])
