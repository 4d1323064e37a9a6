"""A linear classifier fitted by a fixed number of full gradient steps.

Each step is one pass over the rows: a task adds up its own gradient matrix, one row per class and task is
summed, and the model, whose size does not depend on the data, is updated on the driver. Starting from
zero with a fixed rate, the result is a function of the rows alone, whatever their partitions (up to the
rounding of sums), so that any engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.message import _vector_sum, dense, with_argmax
from nodeloom.operators.stats import accuracy
from nodeloom.plans.store import save

#: Partial sums of one class that the first round of adding up keeps apart.
SHARES = 64


@dataclass
class LinearModel:
    """``weights[c]`` are the weights of class c, ``bias`` one number per class."""

    weights: np.ndarray
    bias: np.ndarray


def _gradient(rows: DataFrame, model: LinearModel) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradient of the log loss over (features, label) rows."""
    weights, bias = model.weights, model.bias
    classes, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((classes, width + 1))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            z = x @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), label] -= 1.0
            total[:, :width] += p.T @ x
            total[:, width] += p.sum(axis=0)
        ends = pa.array(np.arange(0, total.size + 1, width + 1, dtype=np.int32))
        share = pa.array([TaskContext.get().partitionId() % SHARES] * classes, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [share, pa.array(np.arange(classes, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["share", "c", "g"])

    parts = rows.mapInArrow(run, "share int, c int, g array<double>")
    some = _vector_sum(parts, ["share", "c"], "g", width + 1)
    found = _vector_sum(some, ["c"], "_out", width + 1).orderBy("c").collect()  # one row per class
    matrix = np.array([r["_out"] for r in found]) if found else np.zeros((classes, width + 1))
    return matrix[:, :width], matrix[:, width]


def fit(table: DataFrame, labels: DataFrame, classes: int, *, steps: int = 5, rate: float = 1.0, reg: float = 0.01) -> LinearModel:
    """Multinomial logistic regression on (node_id, features) with the known ``labels`` (node_id, label).

    ``steps`` steps of ``rate`` along the mean gradient plus ``reg`` times the weights (and bias), from zero. Labels must
    lie in 0 to ``classes`` - 1; rows without one do not count. Without rows all weights stay 0.
    """
    known = labels.filter(F.col("label").isNotNull()).select("node_id", F.col("label").cast("int").alias("label"))
    inside = F.when(F.col("label").between(0, classes - 1), F.col("label")).otherwise(F.raise_error(F.lit("a label outside the classes")))
    rows = save(table.join(known, "node_id").select(F.col("features").cast("array<double>").alias("features"), inside.alias("label")), "rows")
    first = rows.df.select(F.size("features").alias("k")).first()
    model = LinearModel(np.zeros((classes, first["k"] if first else 0)), np.zeros(classes))
    for _ in range(steps if first else 0):
        slope, shift = _gradient(rows.df, model)
        model = LinearModel(model.weights - rate * (slope / rows.rows + reg * model.weights), model.bias - rate * (shift / rows.rows + reg * model.bias))
    rows.drop()
    return model


def predict(model: LinearModel, table: DataFrame) -> DataFrame:
    """(node_id, prediction): the class with the largest margin, ties to the lowest."""
    margins = dense(table.select("node_id", "features"), {"features": model.weights.T}, model.bias, out="margin")
    return with_argmax(margins, "margin").select("node_id", "prediction")


def evaluate(model: LinearModel, table: DataFrame, nodes: DataFrame, split: str = "test") -> DataFrame:
    """Accuracy in percent on one split of ``nodes`` (node_id, label, split)."""
    truth = nodes.filter(F.col("split") == split).select("node_id", "label")
    return accuracy(predict(model, table).join(truth, "node_id"))


def weight_table(model: LinearModel, spark) -> DataFrame:
    """(class, feature, weight); the bias is the feature after the last one."""
    full = np.column_stack([model.weights, model.bias])
    cells = [(c, i, float(full[c, i])) for c in range(full.shape[0]) for i in range(full.shape[1])]
    return spark.createDataFrame(cells, "class bigint, feature bigint, weight double")
