"""Secrets in text: base patterns, and key material confirmed by its structure.

Base kinds are pattern matches. The method's own kinds, ``token`` and ``key``, are reported
only when the decoded candidate has the structure it claims: a signed token's header must be
JSON that names an algorithm and its claims must be JSON; a private key, in PEM armour or as
bare base64 (also wrapped over lines) or hex, must decode to nested DER lengths that fill the
data exactly and begin as a private key does, plain or encrypted, or to the OpenSSH key format
with lengths that fit. Armour may hold header lines and the escapes of a quoted string. Base64
that decodes to a text with such a key or token is reported as one.

Defined results: null text is empty and has no spans; repeated rows are judged one by one;
other columns pass through. A candidate of any length is decoded whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.spans import Span, count, joined, with_spans

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "key")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A dotted part with the two after it; only the part itself is consumed, so the next one is tried too.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+(?=\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
_ESCAPE = re.compile(r"\\+(?:u00([0-9A-Fa-f]{2})|([nrt/]))")
_ENCRYPTED = re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,[0-9A-Fa-f]{16,}\s")
_BREAK = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
_LINE = re.compile(rf"({_BREAK})|[A-Za-z0-9+/_-]+=*")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{80,}")
_LEAST_KEY = 32
#: Base64 of the OpenSSH magic, of armour and of a token.
_KNOWN = ("b3BlbnNzaC1rZXkt", "LS0tLS1CRUdJTi", "ZXlK")
#: Object identifiers of password-based encryption (PKCS 5 and PKCS 12) begin so.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64 with or without padding."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_children(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the values that tile ``data[begin:end]`` exactly, else None."""
    out = []
    while begin < end:
        if begin + 2 > end:
            return None
        tag, size = data[begin], data[begin + 1]
        begin += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or begin + width > end:
                return None
            size = int.from_bytes(data[begin:begin + width], "big")
            begin += width
        if begin + size > end:
            return None
        out.append((tag, begin, begin + size))
        begin += size
    return out


def is_der_key(data: bytes) -> bool:
    """A DER private key: version, then an RSA modulus, an EC octet string, or an algorithm with its key; or an encrypted one."""
    outer = der_children(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_children(data, outer[0][1], outer[0][2])
    if parts and [tag for tag, _, _ in parts] == [0x30, 0x04]:  # encrypted: the scheme with its parameters, and the cipher text
        inner = der_children(data, parts[0][1], parts[0][2])
        scheme = bool(inner) and [tag for tag, _, _ in inner] == [0x06, 0x30] and data[inner[0][1]:inner[0][2]].startswith(_PASSWORD_BASED)
        return scheme and parts[1][2] - parts[1][1] >= _LEAST_KEY
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [tag for tag, _, _ in parts]
    if tags[1] == 0x30 and tags[2] == 0x04:  # algorithm identifier and wrapped key
        inner = der_children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[1] == 0x04:  # elliptic curve
        return parts[1][2] - parts[1][1] >= 16
    return len(tags) >= 6 and all(tag == 0x02 for tag in tags) and parts[1][2] - parts[1][1] >= _LEAST_KEY  # RSA or DSA numbers


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH private format: magic, then cipher, KDF and options as length-prefixed strings."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data)


def is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= _LEAST_KEY and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(text: str) -> bool:
    """Three base64url parts whose header is JSON with an algorithm and whose claims are a JSON object."""
    header, claims = (decode64(part) for part in text.split(".")[:2])
    try:
        head, body = json.loads(header or b""), json.loads(claims or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


_HEADER = base64.urlsafe_b64encode(b'{"alg":""}').decode().rstrip("=")


def _tokens(text: str) -> list[tuple[int, int]]:
    """Signed tokens; a header that fails gives way to the next part, or to a later ``eyJ`` in its part."""
    out, done = [], 0
    for m in _TOKEN.finditer(text):
        part, begin = m.group(), m.start()
        if begin < done:
            continue
        if not is_signed_token(f"{_HEADER}.{m[1]}"):
            continue
        starts = [0] if part[0] in "eICD" else []  # a brace or white space
        at = part.find("eyJ", 1)
        while at >= 0:
            starts.append(at)
            at = part.find("eyJ", at + 1)
        for at in starts:
            if is_signed_token(f"{part[at:]}.{m[1]}"):
                done = m.end(2)
                out.append((begin + at, done))
                break
    return out


def is_armoured(body: str) -> bool:
    """Whether the text between the armour's lines is a private key, its header lines and escapes aside."""
    body = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "/" if m[2] == "/" else "\n", body)
    lines = body.splitlines()
    last = max((i for i, line in enumerate(lines) if ":" in line), default=-1)
    data = decode64("".join(lines[last + 1:]))
    if last >= 0 and "ENCRYPTED" in body and _ENCRYPTED.search(body):  # the cipher text has no structure, its headers have
        return data is not None and len(data) >= _LEAST_KEY and len(data) % 8 == 0
    return is_key(data)


def _kind(data: bytes | None) -> str | None:
    """Kind of decoded base64: a key, or a text that holds a key or a token."""
    if is_key(data):
        return "key"
    try:
        text = (data or b"").decode()
    except UnicodeDecodeError:
        return None
    kinds = {kind for kind, _, _ in confirmed(text)}
    return "key" if "key" in kinds else "token" if kinds else None


def _der_size(line: str) -> int:
    """Bytes of the DER sequence that a base64 line begins, 0 if it begins none."""
    head = decode64(line[:8]) or b""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    if head[1] < 0x80:
        return 2 + head[1]
    width = head[1] & 0x7F
    return 2 + width + int.from_bytes(head[2:2 + width], "big") if 1 <= width <= 4 else 0


def _wrapped(text: str) -> list[Span]:
    """Base64 over several lines: as many as a DER sequence needs, or lines of one width and a shorter last one."""
    out = []
    for run in _WRAPPED.finditer(text):
        lines = [(m.start(), m.end(), m.group()) for m in _LINE.finditer(text, run.start(), run.end()) if not m[1]]
        sizes = [len(line.rstrip("=")) for _, _, line in lines]
        known = [line.startswith(_KNOWN) for _, _, line in lines]
        i = 0
        while i < len(lines):
            stops, need = [], -(-4 * _der_size(lines[i][2]) // 3)
            if need > sizes[i]:
                j, have = i, 0
                while j < len(lines) and have < need:
                    have += sizes[j]
                    j += 1
                stops = [j] if have == need else []
            if known[i] or i == 0 or sizes[i] != sizes[i - 1]:  # lines of one width are read once, and from each known beginning to the next
                j = i + 1
                while j < len(lines) and sizes[j] == sizes[i] and not (known[i] and known[j]):
                    j += 1
                stops += [j + 1] if j < len(lines) and sizes[j] < sizes[i] else []
                stops += [j] if j > i + 1 else []
            for stop in stops:
                kind = _kind(decode64("".join(line for _, _, line in lines[i:stop])))
                if kind:
                    out.append((kind, lines[i][0], lines[stop - 1][1]))
                    i = stop
                    break
            else:
                i += 1
    return out


def confirmed(text: str) -> list[Span]:
    """Tokens and keys, in no order."""
    out: list[Span] = [("token", s, e) for s, e in _tokens(text)]
    if "PRIVATE KEY-----" in text:
        out += [("key", m.start(), m.end()) for m in _ARMOUR.finditer(text) if is_armoured(m[2])]
    covered = [(s, e) for kind, s, e in out if kind == "key"]
    wrapped = [span for span in _wrapped(text) if not any(a < span[2] and span[1] < b for a, b in covered)]
    covered += [(s, e) for _, s, e in wrapped]
    single = {(_kind(decode64(m.group())), m.start(), m.end()) for m in _BLOB.finditer(text)}
    single |= {("key", m.start(), m.end()) for m in _LONG_HEX.finditer(text) if len(m.group()) % 2 == 0 and is_key(bytes.fromhex(m.group()))}
    return out + wrapped + [span for span in single if span[0] and not any(a <= span[1] and span[2] <= b for a, b in covered)]


def find(text: str) -> list[Span]:
    """All spans of a text by start, then by kind in the order of ``KINDS``."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    out += confirmed(text)
    return sorted(out, key=lambda span: (span[1], _RANK[span[0]], span[2]))


def detector() -> Callable[[str], list[Span]]:
    return find


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the secrets of each text."""
    return with_spans(docs, text, out, detector)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans."""
    found = scan(docs.select(key, text), text, "found")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        key, *[count("found", kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
