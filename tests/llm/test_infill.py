"""Fill-in-the-middle: outputs against a plain version, exact round trip, odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from nodeloom.llm import infill

rng = random.Random(5)
PARTS = ["a", "é\n", "\n", "日本語 ", "word ", "<", "<P", ">", "<S", "x\r\n", "😀", "end of a line\n"]
TEXTS = [None, "", "\n", "one line", "<P>", "has <M> inside\nand more\n", "<P\n>", "ends with <", "<S", ">\nafter a cut marker",
         "\n\n\n"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(150)]


def plain_version(key, text, rate=100, spm=50, seed=7):
    """(n, form, prefix code points, middle code points, output)"""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[20]], "doc_id bigint, text string, source string")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_outputs_and_round_trip(docs, rate, spm):
    made = infill.transform(docs, rate=rate, spm=spm)
    got = infill.restore(made).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], r["text"], rate, spm)
        assert r["restored"] == (r["text"] or "") and r["source"] == "x"
    assert {r["form"] for r in got} == {"plain"} | ({"psm"} if rate and spm < 100 else set()) | ({"spm"} if rate and spm else set())


def test_report_hashes(docs):
    for r in infill.report(docs).collect():
        text = TEXTS[3] if r["doc_id"] is None else TEXTS[r["doc_id"]]
        n, form, pre, mid, out = plain_version(r["doc_id"], text)
        assert tuple(r) == (r["doc_id"], n, form, pre, mid, hashlib.sha256(out.encode()).hexdigest(),
                            hashlib.sha256((text or "").encode()).hexdigest())


def test_blocks_smaller_than_a_text(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 7)
    texts = [(t or "").encode() for t in TEXTS]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    draws = np.array([[rng.randrange(1 << 32) for _ in range(4)] for _ in texts])
    out, lay, _ = infill.rearranged(data, bounds, draws, 100, 50)
    again = infill.read_layout(out, lay.bounds, lay.form)
    assert infill.gather(out, again).tobytes() == data.tobytes()
    for name in ("prefix", "middle", "suffix"):
        moved = lay.form != infill.PLAIN
        assert getattr(again, name)[moved].tolist() == getattr(lay, name)[moved].tolist()


def test_very_long_text(spark):
    text = "".join(f"line {i} é\n" for i in range(600_000))
    row = infill.report(spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")).filter("doc_id = 1").first()
    n, form, pre, mid, out = plain_version(1, text)
    assert tuple(row) == (1, n, form, pre, mid, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\n", "mine", "old", 5)], "doc_id int, text string, _digest string, Output string, n int")
    made = infill.transform(docs)
    assert made.columns == ["doc_id", "text", "_digest", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = made.first()
    assert row["_digest"] == "mine" and row["output"] == plain_version(1, "a\nb\n")[4] and row["n"] == 2
    assert infill.report(docs.limit(0)).count() == 0
    assert infill.restore(made.limit(0)).count() == 0


def test_restore_refuses_a_text_without_markers(spark):
    broken = spark.createDataFrame([("no markers", "psm")], "output string, form string")
    with pytest.raises(Exception, match="lacks the markers"):
        infill.restore(broken).collect()
    kept = spark.createDataFrame([("no markers", None), (None, "plain")], "output string, form string")
    assert [r["restored"] for r in infill.restore(kept).collect()] == ["no markers", ""]
