"""User-written messages and reducers, hubs included."""

import numpy as np
import pytest

from nodeloom.operators import custom
from tests.conftest import hub_graph, rows

PAIRS = hub_graph(80)
VALUE = {i: float((i * 37) % 23) / 4 for i in range(80)}


def by_dst(fn):
    groups = {}
    for a, b in PAIRS:
        groups.setdefault(b, []).append(fn(a, b))
    return groups


@pytest.fixture(params=[10_000, 7], ids=["large batches", "small batches"])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_variance_of_weighted_messages(make, batches):
    edges = make.table([(a, b, float(a + b)) for a, b in PAIRS], "src bigint, dst bigint, w double").repartition(5)
    vals = make.table(list(VALUE.items()), "node_id bigint, val double")
    got = dict(rows(custom.update_all(edges, vals, lambda v, w: v * w, custom.VARIANCE, ("val", "w"))))
    want = by_dst(lambda a, b: VALUE[a] * (a + b))
    assert set(got) == set(want) and all(got[n] == pytest.approx(np.var(v)) for n, v in want.items())


def test_own_reducer_with_two_numbers(make, batches):
    """Smallest and largest message at once; the difference is the result."""
    spread = custom.Fold(2, lambda v: np.stack([v, v], axis=1),
                         lambda a, b: np.stack([np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 1], b[:, 1])], axis=1), lambda s: s[:, 1] - s[:, 0])
    got = dict(rows(custom.update_all(make.edges(PAIRS), make.table(list(VALUE.items()), "node_id bigint, val double"), np.sqrt, spread)))
    assert got == pytest.approx({n: max(v) - min(v) for n, v in by_dst(lambda a, b: VALUE[a] ** 0.5).items()})


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_quantiles_with_ties_and_nulls(make, q):
    vals = make.table([(i, None if i == 3 else v) for i, v in VALUE.items()], "node_id bigint, val double")
    want = {}
    for n, v in by_dst(lambda a, b: None if a == 3 else VALUE[a]).items():
        kept = [x for x in v if x is not None]
        if kept:
            want[n] = float(np.quantile(kept, q))
    assert dict(rows(custom.quantile(make.edges(PAIRS), vals, q))) == pytest.approx(want)


def test_empty_inputs(make):
    vals = make.table(list(VALUE.items()), "node_id bigint, val double")
    assert custom.update_all(make.edges(PAIRS).limit(0), vals, np.sqrt, custom.VARIANCE).count() == 0
    assert custom.quantile(make.edges(PAIRS).limit(0), vals).count() == 0
