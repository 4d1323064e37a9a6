"""Personal data and secrets: base patterns against plain versions, and what the methods add."""

import base64
import hashlib
import json
import random

import numpy as np
import pytest

from nodeloom.llm import pii, secrets
from tests.llm import brute

rng = random.Random(11)
LONG = "prose without anything " * 4000 + "mail a.b@c.de and +1 (017) 555-7713 or 10.0.0.1"


def noise(pieces, n=3000, size=25):
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_personal_base_matches_plain_version():
    pieces = ["a", "é", "1", "22", "255", "256", "0", "4111111111111111", " ", "-", ".", "@", "+", "(", ")", "%", "x.y", "\n", "12345", "٣"]
    for text in [LONG, "", "@" * 50, "1." * 50, "1 " * 60, "+1" * 40, "a@b.c@d.e@f", "1" * 5000, *noise(pieces)]:
        assert pii.base_spans(text) == brute.personal(text), text


def test_secret_base_matches_plain_version():
    pieces = ["password", "PassWD", "api_key", "apikey", "ſecret", "secret", "toKen", "=", ":", " ", '"', "'", "abc", "AKIA", "Z9", "0f", "deadbeefdeadbeef",
              "\n", "=a", "+/", "Key", "ABCDEFGHIJKLMNOP"]
    for text in ["", LONG, "f" * 5000, "AKIA" * 30, *noise(pieces)]:
        got = [s for s in secrets.find(text) if s[0] in secrets.BASE]
        assert got == brute.secrets(text), text


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *[der(2, bytes(rng.randrange(1, 256) for _ in range(n))) for n in (64, 3, 64, 32, 32, 32, 32, 32)])
WRAPPED = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
CURVE = der(0x30, der(2, b"\1"), der(4, bytes(32)), der(0xA0, der(6, b"\x2b\x81\x04\x00\x0a")))
OPENSSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + bytes(80)


def armour(data, kind="RSA PRIVATE KEY"):
    text = base64.b64encode(data).decode()
    return f"-----BEGIN {kind}-----\n" + "\n".join(text[i:i + 64] for i in range(0, len(text), 64)) + f"\n-----END {kind}-----"


def part(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


@pytest.mark.parametrize("data", [RSA, WRAPPED, CURVE, OPENSSH])
def test_keys_are_confirmed_by_structure(data):
    for text in (armour(data), base64.b64encode(data).decode(), data.hex(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
        found = [s for s in secrets.find(f"x é {text} y") if s[0] == "key"]
        assert found == [("key", 4, 4 + len(text))], text[:40]
    broken = bytearray(data)
    broken[3 if data is not OPENSSH else 2] ^= 0x55
    for bad in (bytes(broken), data[:-1] if data is not OPENSSH else data[:20], data + b"\0" if data is not OPENSSH else b"x" + data, bytes(60)):
        assert not [s for s in secrets.find(base64.b64encode(bad).decode()) if s[0] == "key"]


def test_signed_tokens_need_a_json_header():
    good = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    assert ("token", 2, 2 + len(good)) in secrets.find(f"a {good} b")
    for bad in (f"{part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln", f"{part({'alg': 'x'})}.{part([1])}.c2ln", "eyJhbGci.eyJub3Q.abc", "eyJ.a.b"):
        assert not [s for s in secrets.find(bad) if s[0] == "token"], bad


def method(text, kind):
    return [text[s:e] for k, s, e in secrets.find(text) if k == kind]


PBES2 = bytes.fromhex("2a864886f70d01050d")
LOCKED = der(0x30, der(0x30, der(6, PBES2), der(0x30, der(0x30, der(6, b"\x2a")), der(0x30, der(6, b"\x2a")))), der(4, bytes(range(80))))


def wrap(data, width=76):
    body = base64.b64encode(data).decode()
    return "\n".join(body[i:i + width] for i in range(0, len(body), width))


def test_armour_with_escapes_headers_and_encrypted_keys():
    for escaped in (json.dumps(armour(WRAPPED, "PRIVATE KEY"))[1:-1], armour(WRAPPED, "PRIVATE KEY").replace("\n", "\\n").replace("=", "\\u003d")):
        assert method(json.dumps({"type": "x"}) + f'"private_key": "{escaped}"', "key") == [escaped]
    locked = armour(bytes(range(64))).replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n", 1)
    assert method(f"a {locked} b", "key") == [locked]
    assert not method(locked.replace("DEK-Info", "Comment"), "key")
    whole = armour(LOCKED, "ENCRYPTED PRIVATE KEY")
    assert method(f"a {whole} b", "key") == [whole]
    digest_info = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, bytes(32)))
    assert not method(base64.b64encode(digest_info).decode(), "key")


@pytest.mark.parametrize("data", [RSA, WRAPPED, CURVE, OPENSSH, LOCKED])
def test_wrapped_and_nested_keys(data):
    for width in (20, 64, 76):
        body = wrap(data, width)
        assert method(f"key:\n{body}\nEnd of it", "key") == [body], width
    nested = base64.b64encode(armour(data).encode()).decode()
    assert method(f"tls.key: {nested}\n", "key") == [nested]
    assert method(wrap(armour(data).encode()) + "\n\nx", "key") == [wrap(armour(data).encode())]
    assert not method(wrap(bytes(300)), "key")


def test_tokens_by_their_header():
    spaced = base64.urlsafe_b64encode(b'{ "alg" : "HS256" }').decode().rstrip("=")
    lined = base64.urlsafe_b64encode(b'\n{\n "alg": "HS256"}').decode().rstrip("=")
    for head in (spaced, lined, part({"alg": "none"})):
        good = f"{head}.{part({'sub': '1'})}.c2ln"
        for before in ("", "eyJhbGciOiJub25l.", "a.b.", "eyJhbGciOiJub25l.eyJhbGciOiJub25l."):
            assert method(f"x {before}{good} y", "token") == [good]
        nested = base64.b64encode(good.encode()).decode()
        assert method(f"token: {nested}", "token") == [nested]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def rows(spark, texts):
    return spark.createDataFrame([(i if i % 5 else None, t, "x", 2) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, found int")


def test_reports(spark):
    texts = [None, "", LONG, "password = hunter22 AKIA" + "A" * 16, "ff" * 20, armour(RSA), "é a@b.co, 4111 1111 1111 1111", "a@b.co"] * 2
    table = rows(spark, texts)
    got = secrets.report(table).collect()
    assert sorted(r["base_sha256"] for r in got) == sorted(digest(brute.secrets(t)) for t in texts)
    assert sorted((r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == sorted(
        tuple(sum(s[0] == k for s in brute.secrets(t)) for k in secrets.BASE) for t in texts)
    got = pii.report(table).collect()
    assert sorted(r["base_sha256"] for r in got) == sorted(digest(brute.personal(t)) for t in texts)
    assert sorted((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == sorted(
        tuple(sum(s[0] == k for s in brute.personal(t)) for k in pii.KINDS) for t in texts)
    for report in (secrets.report, pii.report):
        assert report(table.limit(0)).count() == 0
        assert report(table.select("doc_id", "text").filter("text is null")).count() == 2


def corpus():
    out = []
    for i in range(400):
        phone, card, mail = f"+1 ({i % 900 + 100}) 555-{i:04d}", card_number(), f"u{i}.x@mail{i % 9}.example.com"
        out += [f"Call {phone} now.", f"Paid with {card} today, {i} items.", f"Write to {mail} please.", f"Host 10.0.{i % 200}.{i % 250} in {1900 + i % 130}.",
                f"Version {i % 9}.{i % 7} of {i * 37} parts, page {i}."]
    return out


def card_number():
    body = "".join(rng.choice("123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if brute.luhn(body + c))


def model():
    graph = pii.Graph()
    for i, text in enumerate(corpus()):
        pii.add_document(graph, i, text, pii.base_spans(text))
    pairs = [np.array([(graph.label[a], graph.label[b]) for a, b in e]).reshape(-1, 2) for e in (graph.chain, graph.skip)]
    return pii.fit(graph.features, np.array(graph.label), *pairs)


def test_field_adds_repeated_and_merged_spans_only():
    fitted, card = model(), card_number()
    texts = ["Call +1 (217) 555-7713 now. Later (217) 555-7713 again.", f"Both {card} {card} in a row.",
             "Write to ann.x@mail1.example.com or ann.x@mail1 today.", "In 2020 there were 1500 items, 12.5 each, 3-4 a day.", "", "no digits"]
    found = pii.find(texts, fitted)
    assert [texts[0][s:e] for k, s, e in found[0] if k == "phone"] == ["+1 (217) 555-7713", "(217) 555-7713"]
    assert [texts[1][s:e] for _, s, e in found[1]] == [card, card]
    assert ("email", 9, 32) in found[2] and len(found[2]) == 2
    assert found[3:] == [[], [], []]
    for text, spans in zip(texts, found, strict=True):
        assert set(pii.base_spans(text)) <= set(spans)
    assert pii.find(texts, None) == [pii.base_spans(t) for t in texts]


def test_field_is_fitted_on_the_whole_table(spark):
    texts = [" ".join(str(n) for n in range(900))] + [f"{i} and {i + 1} of {i % 7}" for i in range(500)] + corpus() + ["10.1.2.3 "] + ["none"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    fitted = pii.fit_model(table, fit_words=800)
    again = "Call +1 (217) 555-7713 now. Later (217) 555-7713 again."
    assert fitted is not None and len(pii.find([again], fitted)[0]) == 2
    rare = spark.createDataFrame([(i, f"{i} of {i + 1} and {i * 7}") for i in range(3000)] + [(-1, "Write to a.b@c.example.com now.")], "doc_id bigint, text string")
    assert pii.fit_model(rare, fit_words=100) is not None


def test_messages_agree_with_exact_marginals_on_a_chain():
    fitted = model()
    graph = pii.Graph()
    pii.add_document(graph, 0, "+1 (217) 555-7713 x 12", [])
    assert graph.chain and not graph.skip
    chance = pii.posterior(graph, fitted, rounds=60)
    n, size = len(graph.spot), len(pii.LABELS)
    unary = np.array([fitted.node[f].sum(0) for f in graph.features])
    exact = np.zeros((n, size))
    for code in range(size ** n):
        labels = [code // size ** i % size for i in range(n)]
        score = sum(unary[i, a] for i, a in enumerate(labels)) + sum(fitted.chain[labels[a], labels[b]] for a, b in graph.chain)
        for i, a in enumerate(labels):
            exact[i, a] += np.exp(score)
    assert np.allclose(chance, exact / exact.sum(1, keepdims=True), atol=1e-4)


def test_mask_changes_text_and_length_only(spark):
    texts = ["mail a@b.co now", "clean text", None, "ip 10.0.0.1, 10.0.0.1"]
    table = spark.createDataFrame([(i, t, "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, kind string, n_chars bigint")
    got = pii.mask(table, size="n_chars").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["mail [EMAIL] now", "clean text", None, "ip [IP], [IP]"]
    assert [r["n_chars"] for r in got] == [16, 10, None, 13]
    assert pii.mask(table, size="n_chars").columns == table.columns
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 3, 5)]) == "a[IP]f"
    beside = "4111111111111111 1.2.3.4"
    assert [k for k, _, _ in pii.base_spans(beside)] == ["ip"] and pii.cleaned(beside, pii.base_spans(beside)) == "[CARD] [IP]"
