"""Tables that already have the columns an operator adds, and the bounded search for rare kinds."""

import pytest

from nodeloom.llm import contamination, maincontent, pii, secrets, weaklabel

TEXT = "write to ann@example.org or call +44 20 7946 0958 now. password=hunter22 ok " + "word " * 20


def docs(spark, *extra):
    schema = "doc_id bigint, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(i, TEXT, *["old"] * len(extra)) for i in range(5)], schema)


def test_added_columns_replace_those_of_the_same_name(spark):
    for scan in (secrets.scan, pii.scan):
        plain = scan(docs(spark)).select("spans").collect()
        got = scan(docs(spark, "Spans", "keep"))
        assert got.columns == ["doc_id", "text", "keep", "spans"] and got.select("spans").collect() == plain
    items = spark.createDataFrame([(1, "word word word")], "item_id bigint, text string")
    found = contamination.find(docs(spark, "hits", "keep"), items)
    assert found.columns == ["doc_id", "text", "keep", "hits"] and found.first()["hits"]["contaminated"]
    judged = weaklabel.classify(docs(spark, "score", "KEPT", "keep"))
    assert judged.columns == ["doc_id", "text", "keep", "posterior", "score", "kept"] and isinstance(judged.first()["kept"], bool)
    apart = weaklabel.classify(docs(spark, "score"), prefix="w_")
    assert apart.columns == ["doc_id", "text", "score", "w_posterior", "w_score", "w_kept"] and apart.first()["score"] == "old"
    pages = spark.createDataFrame([(1, "old", "<article><p>" + "The main text of the page. " * 9 + "</p></article>")], "page_id bigint, text string, html string")
    text = maincontent.extract(pages)
    assert text.columns == ["page_id", "text"] and text.first()["text"].startswith("The main text")


@pytest.mark.parametrize("parts", [1, 7])
def test_rare_kinds_are_drawn_at_a_bounded_rate(spark, monkeypatch, parts):
    """Many words of a common kind fill the sample; a rare kind is found all the same, and never beyond the bound."""
    common = [(i, " ".join(f"a{i}x{j}@example.org" for j in range(20))) for i in range(60)]
    rare = [(100 + i, f"server 10.0.{i}.7 is up, 192.168.{i}.9 too") for i in range(40)]
    seen = []
    original = pii.fit
    monkeypatch.setattr(pii, "fit", lambda x, label, *rest: seen.append(label.tolist()) or original(x, label, *rest))
    monkeypatch.setattr(pii, "share", lambda table, part: table.filter("doc_id < 100"))  # a sample that misses the rare kind
    table = spark.createDataFrame(common + rare, "doc_id bigint, text string").repartition(parts)
    model = pii.fit_model(table, fit_words=60)
    (labels,) = seen
    ip = pii.LABELS.index("ip")
    assert model is not None and 5 <= labels.count(ip) <= 30 and len(labels) <= 60
