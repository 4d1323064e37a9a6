"""Chains against enumeration, words against a pattern, held-out accuracy, code switching, odd inputs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from nodeloom.llm import langid
from nodeloom.llm.chain import forward_backward

rng = random.Random(12)
SOUNDS = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ver", "keit", "ä"], "cc": ["eau", "oi", "ç", "que"]}
SMALL = {"aa": ["na", "ko"], "bb": ["der", "und"], "cc": ["le", "la"]}


def sentence(lang, words=12):
    return " ".join(rng.choice(SMALL[lang]) if rng.random() < 0.3 else "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4)))
                    for _ in range(words)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(SOUNDS))
        rows.append((i, sentence(lang, rng.randrange(3, 60)), lang if i % 10 else None, "x"))
    rows += [(300, None, "aa", "x"), (301, "", "bb", "x"), (302, "12 !?", "cc", "x"), (303, "— 😀 ⅓", None, "x"), (None, sentence("cc"), "cc", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs.filter(~langid.held_out(docs["doc_id"])))


@pytest.mark.parametrize(("n", "labels"), [(1, 3), (2, 2), (7, 3), (9, 2), (6, 4)])
def test_marginals_match_enumeration(n, labels):
    draw = np.random.default_rng(n)
    unary, start, move = draw.normal(size=(n, labels)) * 3, draw.normal(size=labels), draw.normal(size=(labels, labels)) * 2
    first = np.arange(n) % 4 == 0
    first[n - 1] = True
    word, pair, total = np.zeros((n, labels)), np.zeros((labels, labels)), 0.0
    for path in itertools.product(range(labels), repeat=n):
        value = np.exp(sum(unary[i, y] + (start[y] if first[i] else move[path[i - 1], y]) for i, y in enumerate(path)))
        total += value
        for i, y in enumerate(path):
            word[i, y] += value
            if not first[i]:
                pair[path[i - 1], y] += value
    got = forward_backward(unary, start, move, first)
    assert np.allclose(got.word, word / total) and np.allclose(got.pair, pair / total) and np.isclose(got.log_sum, np.log(total))


def test_hard_weights_do_not_underflow():
    unary = np.zeros((5000, 2))
    unary[:2500, 0] = 400.0
    unary[2500:, 1] = 400.0
    first = np.zeros(5000, bool)
    first[0] = True
    got = forward_backward(unary, np.zeros(2), np.array([[0.0, -50.0], [-50.0, 0.0]]), first)
    assert np.all(got.word[:2500, 0] > 0.99) and np.all(got.word[2500:, 1] > 0.99)


def test_words_are_runs_of_letters_in_their_places():
    texts = ["L'été, ça va?\nÜBER 12straße", "", None, "ÀB 日本語 ok", "éa x😀y", "-"]
    tokens = langid.Tokens.of(pa.array(texts).slice(0))
    for t, text in enumerate(texts):
        want = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{M}]+", text or "")]
        got = [(int(tokens.start[i] - tokens.begin[t]), int(tokens.end[i] - tokens.begin[t]),
                tokens.letters[tokens.start[i]:tokens.end[i]].tobytes().decode("utf-32-le")) for i in range(tokens.first[t], tokens.first[t + 1])]
        assert got == want
    hashes, seen = tokens.hashes(), {}
    for i in range(len(hashes)):
        assert seen.setdefault(tokens.letters[tokens.start[i]:tokens.end[i]].tobytes(), hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_held_out_accuracy_and_und(docs):
    got = langid.report(docs).collect()
    assert len(got) == 305
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]][0] and r["doc_id"] not in (300, 301, 302, 303)]
    assert len(held) > 30 and all(r["lang_pred"] == truth[r["doc_id"]][0] for r in held)
    for r in got:
        if r["doc_id"] in (300, 301, 302, 303):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in SOUNDS and 0.0 < r["score"] <= 1.0
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]


def test_language_and_key_are_no_inputs_of_a_prediction(docs, model):
    plain = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    other = docs.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang", "'y' as source")
    assert {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(other, model).collect()} == plain


def test_score_is_the_mean_marginal_over_all_paths(spark, model):
    text = "kalo der eauoi"
    tokens = langid.Tokens.of(pa.array([text]))
    unary = model.unary(tokens)
    n, labels = unary.shape
    mean, total = np.zeros(labels), 0.0
    for path in itertools.product(range(labels), repeat=n):
        value = np.exp(sum(unary[i, y] + (model.start[y] if i == 0 else model.move[path[i - 1], y]) for i, y in enumerate(path)))
        total += value
        mean += value * np.bincount(path, minlength=labels)
    mean /= total * n
    row = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    assert row["lang_pred"] == model.langs[mean.argmax()] and abs(row["score"] - mean.max()) < 1e-8


def test_switched_text_is_split_into_runs(spark, model):
    parts = [("aa", sentence("aa", 25)), ("bb", sentence("bb", 25)), ("cc", sentence("cc", 25))]
    text = " ".join(p for _, p in parts)
    row = langid.identify(spark.createDataFrame([(1, text, "mine")], "doc_id int, text string, RUNS string"), model).first()
    assert row.__fields__ == ["doc_id", "text", "lang_pred", "score", "runs"]
    label = ["" for _ in text]
    for run in row["runs"]:
        label[run["start"]:run["end"]] = [run["lang"]] * (run["end"] - run["start"])
    at = right = 0
    for lang, part in parts:
        right += sum(x == lang for x in label[at:at + len(part)])
        at += len(part) + 1
    assert right >= 0.95 * len(text)


def test_fitting_raises_the_likelihood():
    texts, labels = langid.chains([(lang, sentence(lang, 40).rstrip(".").split(" ")) for lang in SOUNDS for _ in range(5)])
    assert sum(map(len, texts)) == sum(map(len, labels)) == 600
    values = []
    for steps in (1, 10, 60):
        model = langid.fit(texts, labels, np.zeros(0, np.uint64), np.zeros((0, 3)), sorted(SOUNDS), steps)
        tokens = langid.Tokens.of(pa.array([" ".join(t) for t in texts]))
        truth = np.array([sorted(SOUNDS).index(x) for y in labels for x in y])
        unary, got = model.unary(tokens), model.marginals(tokens)
        fresh = np.isin(np.arange(600), tokens.first[:-1])
        path = unary[np.arange(600), truth].sum() + model.start[truth[fresh]].sum()
        values.append(path + sum(model.move[truth[i - 1], truth[i]] for i in range(600) if not fresh[i]) - got.log_sum)
    assert values[0] < values[1] < values[2] < 0 and values[2] > -60


def test_lexicon_counts_every_training_text(spark):
    rows = [("na ko na", "aa")] * 40 + [("der na", "bb")] * 20 + [("rare", "aa")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    words, shares = langid.lexicon_of(docs, "text", "lang", ["aa", "bb"])
    tokens = langid.Tokens.of(pa.array(["na ko der rare"]))
    model = langid.Model.blank(["aa", "bb"], words, shares)
    share = 80 / 120 / (80 / 120 + 20 / 40)  # "rare" occurs too seldom to count
    assert len(words) == 3 and np.allclose(model.shares_of(tokens.hashes()), [[share, 1 - share], [1, 0], [0, 1], [0, 0]])
    assert len(langid.lexicon_of(docs, "text", "lang", ["aa", "bb"], most=0)[0]) == 0


def test_nothing_to_learn_and_empty_tables(spark, docs, model):
    unlabelled = docs.withColumn("lang", docs["lang"].substr(99, 1)).filter("lang is null")
    assert langid.learn(unlabelled) is None
    assert {(r["lang_pred"], r["score"]) for r in langid.report(unlabelled).collect()} == {("und", 0.0)}
    assert langid.report(docs.limit(0)).count() == 0
    assert langid.identify(docs.limit(0), model).count() == 0


def test_very_long_text(spark, model):
    text = (sentence("bb", 1000) + " ") * 300 + "x" * 100_000
    row = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    assert row["lang_pred"] == "bb" and row["score"] > 0.9 and row["runs"][-1]["end"] == len(text)
