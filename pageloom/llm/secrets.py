"""Secret scans: assignments, access keys and hex strings, and encoded keys confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pageloom.llm.text import map_texts

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Texts without a match of this hold nothing that the scans below could find (it is a superset of them).
PREFILTER = (r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-fA-F]{24}|[A-Za-z0-9+/_-]{32}"
             r"|-----BEGIN |[eICD][A-Za-z0-9_-]{9}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{2}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: In order of listing; the last three are confirmed by structure.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
# a line end may also be the two characters that stand for it inside a quoted string
_BREAK = r"(?:\\[rn]|[\r\n])"
_PEM = re.compile(
    r"-----BEGIN [A-Z0-9 ]{1,40}-----((?:" + _BREAK + r"{0,4}[A-Za-z][A-Za-z-]{1,30}:[^\r\n\\]{0,200}" + _BREAK
    + r"){0,8}+)((?:[A-Za-z0-9+/=\s]|\\[rnt])++)-----END [A-Z0-9 ]{1,40}-----")
_CIPHER = re.compile(r"DEK-Info:\x20*[A-Z0-9-]{3,40},((?:[0-9A-Fa-f]{2})+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{32,}+" + _BREAK + r"{1,4}+[\x20\t]*+)++(?:[A-Za-z0-9+/]++={0,2})?")
_ANY_HEX = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}+")
# an object begins with a brace or white space, so base64 of it with one of four letters
_JWT = re.compile(
    r"(?:(?<![A-Za-z0-9_-])|(?<=\\[rnt]))[eICD][A-Za-z0-9_-]{9,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def _decoded(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the contents of the item at ``at``; None if its length is no DER or too long."""
    if at + 2 > len(data):
        return None
    size, begin = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or begin + n > len(data):
            return None
        size, begin = int.from_bytes(data[begin:begin + n], "big"), begin + n
        if size < 0x80 or size >> (8 * (n - 1)) == 0:
            return None  # not the shortest form
    return (data[at], begin, begin + size) if begin + size <= len(data) else None


def is_key_der(data: bytes) -> bool:
    """A sequence that fills the data, of whole items, nested sequences too, with a number or a sequence."""
    top = _der_item(data, 0)
    if not top or top[0] != 0x30 or top[2] != len(data) or len(data) < 24:
        return False
    stack, seen = [top[1:]], []
    while stack:
        at, end = stack.pop()
        while at < end:
            item = _der_item(data[:end], at)
            if item is None:
                return False
            tag, begin, at = item
            seen.append(tag)
            if tag in (0x30, 0x31, 0xA0, 0xA1, 0xA3):
                stack.append((begin, at))
    return len(seen) >= 2 and (0x02 in seen or 0x03 in seen) and set(seen) <= {
        0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x17, 0x18, 0x30, 0x31, 0xA0, 0xA1, 0xA3}


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or length-prefixed fields that fill the data and begin with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        names = []
        for _ in range(3):
            size = int.from_bytes(data[:4], "big")
            if len(data) < 4 + size:
                return False
            names.append(data[4:4 + size])
            data = data[4 + size:]
        return names[0] in (b"none", b"aes256-ctr", b"aes256-cbc", b"aes256-gcm@openssh.com") and len(data) >= 4
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0] in _SSH_NAMES


def is_token_header(segment: str) -> bool:
    """The first part of a signed token: base64 of a JSON object that names an algorithm."""
    try:
        told = json.loads(_decoded(segment) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(told, dict) and isinstance(told.get("alg"), str)


def is_sealed_key(headers: str, data: bytes) -> bool:
    """An encrypted key: headers name cipher and first block, and the data is whole blocks of that size."""
    cipher = _CIPHER.search(headers)
    block = len(cipher[1]) // 2 if cipher else 0
    return "ENCRYPTED" in headers and block in (8, 16) and len(data) >= 2 * block and len(data) % block == 0


def _quoted(text: str, start: int) -> int:
    """1 if the character at ``start`` belongs to a line end or tab spelled in a quoted string, else 0."""
    return int(start > 0 and text[start - 1] == "\\" and text[start] in "nrt")


def _wrapped(text: str, start: int, end: int) -> list[tuple[int, int, bytes | None]]:
    """The lines from ``start`` to ``end`` as one candidate, and without the last, which may be a word of what follows."""
    skip, pieces = _quoted(text, start), []
    at = start + skip
    for gap in re.finditer(_BREAK + r"+[\x20\t]*", text[at:end]):
        pieces.append((at, start + skip + gap.start()))
        at = start + skip + gap.end()
    if at < end:
        pieces.append((at, end))
    shorter = [pieces[:n] for n in (len(pieces), len(pieces) - 1) if n >= 2]
    return [(p[0][0], p[-1][1], _decoded("".join(text[a:b] for a, b in p))) for p in shorter]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all secrets, in that order; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    candidates = []
    for m in _PEM.finditer(text):
        data = _decoded(re.sub(r"\\[rnt]|\s", "", m[2]))
        if data and m[1] and is_sealed_key(m[1], data):
            found.append((m.start(2), 3, m.end(2)))
        candidates.append((m.start(2), m.end(2), data))
    for m in _BASE64.finditer(text):
        candidates += [(m.start() + cut, m.end(), _decoded(m[0][cut:])) for cut in range(_quoted(text, m.start()) + 1)]
    for m in _WRAPPED.finditer(text):
        candidates += _wrapped(text, m.start(), m.end())
    candidates += [(m.start(), m.end(), bytes.fromhex(m[0])) for m in _ANY_HEX.finditer(text) if len(m[0]) % 2 == 0]
    reach = {3: 0, 4: 0}
    for start, end, data in sorted(candidates, key=lambda c: (c[0], -c[1])):
        kind = 3 if data and is_key_der(data) else 4 if data and is_ssh_key(data) else None
        if kind and end > reach[kind]:  # a key is told once, by its longest span
            found.append((start, kind, end))
            reach[kind] = end
    found += [(m.start(), 5, m.end()) for m in _JWT.finditer(text) if is_token_header(m[0].split(".", 1)[0])]
    return sorted(set(found))


def find_secrets(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``secrets``: array of (kind, start, end) for each row of ``docs``.

    Kinds assign, access and hex are patterns; der, ssh and jwt are base64 or hex whose decoded bytes
    are a key encoding with consistent nested lengths (or the whole blocks of an encrypted one), length-prefixed
    key fields, or a token with a header naming its algorithm. Base64 may be wrapped over lines, armoured or
    not, and its line ends may be spelled out as in a quoted string. Spans are sorted by start, then kind; spans of different kinds may
    overlap. Null, empty and clean texts give an empty array; rows are scanned one by one, whole, so
    repeated rows give the same; no shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def compute(texts):
            maybe = pc.match_substring_regex(pa.array(texts, pa.binary()).cast(pa.string()), PREFILTER).to_pylist()
            return [pa.array([[
                {"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.decode("utf-8"))] if m else []
                for t, m in zip(texts, maybe)], kind)]
        return compute

    return map_texts(docs, make, "secrets array<struct<kind: string, start: bigint, end: bigint>>", keep, text)
