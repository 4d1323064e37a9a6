"""Plain versions of the operators, one document at a time, for small fixtures."""

import re
import zlib
from collections import Counter

import numpy as np

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    n = len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    chars = sum(map(len, w))
    failed = n < 10 or 100 * len(hit) > 20 * n
    other = 10 * symbols > 3 * n or (dup >= 3 and 10 * dup > 3 * len(lines)) or 2 * chars < 3 * n
    return n, chars, symbols, dup, len(hit), failed, not failed and not other


def contamination(text, items, window=13):
    """(words, hit words, item ids, contaminated) for items (id, text)."""
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        k = min(len(b), window)
        grams = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found |= {item} - {None}
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(docs, threshold=0.8):
    """{id: (class, class size, copies, links)} by comparing all pairs of texts."""
    texts = {}
    for ident, text in docs:
        texts.setdefault(text or "", []).append(ident)
    names, sets = list(texts), [shingles(t) for t in texts]
    parent, links = list(range(len(names))), [0] * len(names)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) >= threshold * union - 1e-9:
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    members = {}
    for i, name in enumerate(names):
        members.setdefault(root(i), []).extend(texts[name])
    return {d: (min(members[root(i)]), len(members[root(i)]), len(texts[name]), links[i])
            for i, name in enumerate(names) for d in texts[name]}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    """Base spans by kind, then start, with the patterns as the contract writes them."""
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def secrets(text):
    """Base spans by start, then kind."""
    text = text or ""
    word = "(password|passwd|secret|token|api_?key)"
    either = re.sub(r"[a-z]", lambda m: f"[{m.group().upper()}{m.group()}]", word)
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(either + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def check_packing(pieces, docs, tokenizer, length=4096):
    """Assert that pieces cover every id of every document once; returns the share of padding.

    ``pieces`` are (id, start, length, crc, doc_tokens, sequence, offset); ids of ``docs`` are unique.
    """
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for ident, text in docs:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for _, start, size, crc, total, _, _ in sorted(by_doc[ident], key=lambda p: p[1]):
            assert start == at and size > 0 and total == len(ids)
            assert zlib.crc32(ids[start:start + size].tobytes()) == crc
            at += size
        assert at == len(ids)
    padding = 0
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(1, padding + sum(p[2] for p in pieces))
