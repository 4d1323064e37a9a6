"""The corpus pipeline against plain versions of its stages, and its stages on odd tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from nodeloom.llm import pii
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(corpus_pipeline.TOKENIZER)


def plain(docs, items):
    """(id, text) that reach the packing stage."""
    kept = [(i, t) for i, t in docs if brute.quality(t)[-1]]
    classes = brute.near_copies(kept)
    first = {}
    for i, t in kept:
        first[classes[i][0]] = min(first.get(classes[i][0], (i, t)), (i, t))
    clean = [(i, t) for i, t in first.values() if not brute.contamination(t, items)[3]]
    return [(i, pii.cleaned(t, brute.personal(t))) for i, t in clean]


def test_pipeline_matches_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(docs, items)
    assert 0 < len(want) < len(docs)
    pieces = [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
              for r in corpus_pipeline.run(spark, SF).collect()]
    assert brute.check_packing(pieces, want, TOKENIZER) < 0.1


def sentence(k):
    return " ".join(f"word{k}x{i}" for i in range(25)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, sentence(1), "en", "a", 5), (1, sentence(1), "en", "a", 5), (2, sentence(1), None, None, None), (None, sentence(2), "en", "a", 1),
            (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, sentence(3) + " mail a@b.co " + sentence(4), "en", "a", 9), (6, "long " + sentence(5) * 900, "en", "a", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns_and_survive_odd_tables(spark, odd, stage):
    fn = dict(corpus_pipeline.STAGES)[stage]
    more = odd.selectExpr("*", "'x' AS kept", "1 AS hits", "2 AS node", "'y' AS digest", "3 AS n_words", "'z' AS spans")
    for docs in (odd, more):
        got = fn(spark, docs, SF)
        assert got.columns == docs.columns
        kept = {r["doc_id"] for r in got.select("doc_id").collect()}
        assert {1, None, 5} <= kept
        assert fn(spark, docs.limit(0), SF).count() == 0


def test_stages_in_order(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {1, None, 5} | ({6} & set(got))
    assert "[EMAIL]" in got[5]["text"] and got[5]["n_chars"] == len(got[5]["text"])
    assert got[1]["n_chars"] == 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(got)
