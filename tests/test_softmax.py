"""Gradient steps of the linear classifier against numpy."""

import numpy as np
import pytest

from nodeloom.operators import softmax
from tests.conftest import rows

RNG = np.random.default_rng(3)
X = RNG.normal(size=(90, 5))
Y = np.argmax(X[:, :3] + RNG.normal(size=(90, 3)) * 0.2, axis=1)


def plain_fit(x, y, classes, steps, rate, reg):
    w = np.zeros((classes, x.shape[1] + 1))
    full = np.column_stack([x, np.ones(len(x))])
    for _ in range(steps):
        z = full @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= rate * (p.T @ full / len(x) + reg * w)
    return w


@pytest.fixture(scope="module")
def tables(spark):
    feats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(X)], "node_id bigint, features array<double>").repartition(5)
    nodes = spark.createDataFrame([(i, None if i % 10 == 0 else int(c), "train" if i % 3 else "test") for i, c in enumerate(Y)],
                                  "node_id bigint, label int, split string")
    return feats, nodes


@pytest.mark.parametrize("steps", [0, 1, 6])
def test_weights_match_plain_steps(spark, tables, steps):
    feats, nodes = tables
    model = softmax.fit(feats, nodes.filter("split = 'train'"), 3, steps=steps, rate=0.8, reg=0.02)
    train = [i for i in range(90) if i % 3 and i % 10]
    want = plain_fit(X[train], Y[train], 3, steps, 0.8, 0.02)
    assert np.allclose(np.column_stack([model.weights, model.bias]), want)
    got = rows(softmax.weight_table(model, spark))
    assert np.allclose([w for *_, w in got], want.ravel())


def test_accuracy_of_a_split(tables):
    feats, nodes = tables
    model = softmax.fit(feats, nodes.filter("split = 'train'"), 3, steps=30)
    w = np.column_stack([model.weights, model.bias])
    guess = np.argmax(np.column_stack([X, np.ones(90)]) @ w.T, axis=1)
    assert dict(rows(softmax.predict(model, feats))) == dict(enumerate(guess.tolist()))
    test = [i for i in range(0, 90, 3) if i % 10]
    row = softmax.evaluate(model, feats, nodes).first()
    assert row["n"] == len(test) and row["accuracy"] == pytest.approx(100 * np.mean(guess[test] == Y[test])) and row["accuracy"] > 70


def test_no_rows_and_labels_out_of_range(tables):
    feats, nodes = tables
    model = softmax.fit(feats, nodes.limit(0), 3)
    assert model.weights.shape == (3, 0) and model.bias.tolist() == [0, 0, 0]
    with pytest.raises(Exception, match="outside the classes"):
        softmax.fit(feats, nodes, 2)
