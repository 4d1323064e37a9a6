"""Near copies: components, verification blocks and the whole join against all pairs."""

import random

import numpy as np
import pytest

from nodeloom.llm import nearcopies
from nodeloom.plans.components import components
from tests.llm import brute

rng = random.Random(7)
WORDS = [f"w{i}" for i in range(3000)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def docs():
    out = [None, "", "", " . ", "one two", "One, two!", "one two three", text(5000)]
    for size in (6, 30, 120):
        base = text(size)
        out += [base, base, base.upper()] + [edited(base, c) for c in (1, 1, 2, 3, 5, 9)]
    hub = text(200)
    out += [edited(hub, rng.randrange(1, 4)) for _ in range(70)]
    passage = text(40)
    out += [text(20) + " " + passage + " " + text(20) for _ in range(60)]
    out += [out[7], out[7] + " more"]
    return list(enumerate(out))


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r[0]: tuple(r)[1:] for r in nearcopies.report(table, settings=nearcopies.Settings(**options)).collect()}


def test_join_matches_all_pairs(spark, docs):
    want = brute.near_copies(docs)
    assert run(spark, docs) == want
    assert run(spark, docs, block_nodes=16, block_shingles=3000) == want  # every group in many blocks


def test_blocks_without_nodes_count_no_pair_again(spark):
    rows = []
    for _ in range(16):  # pairs cut into two blocks each; in about half of them one block has no node
        base = text(200)
        rows += [base, f"{base} more"]
    rows = list(enumerate(rows))
    assert run(spark, rows, block_shingles=250) == brute.near_copies(rows)


def test_shorter_prefixes_are_tried_until_the_recall_is_reached(spark, docs):
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    first = nearcopies.join(table, settings=nearcopies.Settings(target=0.5))
    assert first.depth == nearcopies.DEPTHS[0] and 0.5 <= first.recall <= 1
    last = nearcopies.join(table, settings=nearcopies.Settings(target=1.0))
    assert last.depth == nearcopies.DEPTHS[-1]
    assert nearcopies.recall_at(np.array(0.8), nearcopies.DEPTHS[-1], nearcopies.TREES) > nearcopies.TARGET_RECALL


def test_deduplicate_keeps_one_row_per_class_and_all_columns(spark):
    base = text(60)
    rows = [(3, base, "a", "p"), (1, edited(base, 1), "b", "q"), (1, edited(base, 1), "b", "q"), (7, text(50), None, None),
            (7, None, "c", "r"), (None, None, "d", "s"), (None, base, "e", "t")]
    rows[2] = rows[1]  # a repeated row
    table = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, node string")
    kept = nearcopies.deduplicate(table)
    assert kept.columns == table.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in table.collect() if r["digest"] in ("b",)][:1] + [
        r for r in table.collect() if r["doc_id"] == 7]))
    assert nearcopies.deduplicate(table.limit(0)).count() == 0


def test_null_ids_name_their_class_by_a_negative_number(spark):
    got = nearcopies.report(spark.createDataFrame([(None, "a b c"), (None, "d e f")], "doc_id bigint, text string")).collect()
    assert len({r["class_id"] for r in got}) == 2 and all(r["class_id"] < 0 for r in got)


def test_components_of_paths_hubs_and_loops(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300), (5, 5), (500, 400), (400, 500)]
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).df.collect()}
    assert len({got[i] for i in range(n + 1)}) == 1
    assert len({got[100 + i] for i in range(40)}) == 1
    assert got[400] == got[500] and 300 not in got
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a bigint, b bigint")).rows == 0


def test_compare_counts_links_in_column_chunks(monkeypatch):
    monkeypatch.setattr(nearcopies, "COLUMNS", 7)
    sets = [np.unique(np.array(s, np.uint64)) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3], list(range(50, 90)), list(range(51, 90)), [7])]
    links, roots, bins = nearcopies.compare(sets, np.zeros(6, int), 0.8)
    assert links.tolist() == [1, 1, 0, 1, 1, 0] and roots.tolist() == [0, 0, 2, 3, 3, 5] and bins.sum() == 2
    links, _, _ = nearcopies.compare(sets, np.array([0, 0, 0, 0, 1, 1]), 0.8)
    assert links.tolist() == [0, 0, 0, 1, 1, 0]
