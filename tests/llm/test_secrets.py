"""Spans confirmed by structure, planted in texts at known places."""

import base64
import json
import time

import pytest

from pageloom.llm.secrets import find_secrets, spans

DER, SSH, JWT = 3, 4, 5


def _item(tag, data):
    size = len(data).to_bytes(2, "big")
    head = bytes([len(data)]) if len(data) < 0x80 else (b"\x81" + size[1:] if size[0] == 0 else b"\x82" + size)
    return bytes([tag]) + head + data


def _bytes(n, seed=7):
    return bytes((seed * i * i + 31 * i + 5) % 127 + 1 for i in range(n))


KEY = _item(0x30, _item(2, b"\0") + b"".join(_item(2, _bytes(n, n)) for n in (129, 3, 128, 65)))
B64 = base64.b64encode(KEY).decode()
LINES = [B64[i:i + 64] for i in range(0, len(B64), 64)]
SSH_KEY = base64.b64encode(b"".join(
    len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", _bytes(32)))).decode()


def _found(text, *kinds):
    return [(k, text[a:b]) for a, k, b in spans(text) if k in kinds]


def _token(header):
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return ".".join([part(header), part(b'{"sub": 1}'), part(_bytes(32))])


def test_plain_key_of_one_line():
    assert _found(f"key: {B64} and more", DER) == [(DER, B64)]
    assert _found(f"x {SSH_KEY} y", SSH) == [(SSH, SSH_KEY)]


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", "\\r\\n"])
def test_key_in_armour(gap):
    body = gap + gap.join(LINES) + gap
    text = f'"private": "-----BEGIN RSA PRIVATE KEY-----{body}-----END RSA PRIVATE KEY-----", "n": 1'
    assert _found(text, DER) == [(DER, body)]


@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", "\n   "])
@pytest.mark.parametrize("after", ["", "\n", "\nwords follow", "\n\nend"])
def test_key_wrapped_without_armour(gap, after):
    assert _found("see\n" + gap.join(LINES) + after, DER) == [(DER, gap.join(LINES))]
    assert _found("quoted\\n" + gap.join(LINES) + after, DER) == [(DER, gap.join(LINES))]


@pytest.mark.parametrize("gap", ["\n", "\\n"])
def test_encrypted_key(gap):
    data = base64.b64encode(_bytes(160)).decode()
    heads = f"{gap}Proc-Type: 4,ENCRYPTED{gap}DEK-Info: AES-128-CBC,{'0A' * 16}{gap}"
    body = gap + gap.join(data[i:i + 64] for i in range(0, len(data), 64)) + gap
    frame = "-----BEGIN EC PRIVATE KEY-----{}{}-----END EC PRIVATE KEY-----"
    assert _found(frame.format(heads, body), DER) == [(DER, body)]
    # ciphertext that is not whole blocks, or no header at all: nothing is confirmed
    assert _found(frame.format(heads, gap + base64.b64encode(_bytes(159)).decode() + gap), DER) == []
    assert _found(frame.format("", body), DER) == []


def test_hex_in_any_case():
    mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(KEY.hex()))
    for text in (KEY.hex(), KEY.hex().upper(), mixed):
        assert _found(f"<{text}>", DER) == [(DER, text)]


@pytest.mark.parametrize("header", [b'{"alg":"HS256"}', b'{\n "alg": "none"}', b' {"alg": "RS256"}', b'\r\n{"typ":"JWT","alg":"ES256"}'])
def test_signed_token(header):
    token = _token(header)
    assert _found(f"Bearer {token}, ok", JWT) == [(JWT, token)]
    assert _found(f'"a\\n{token}"', JWT) == [(JWT, token)]


def test_look_alikes_stay_out():
    wrong = bytearray(KEY)
    wrong[3] += 1
    texts = [base64.b64encode(bytes(wrong)).decode(), "\n".join(LINES[1:]), B64[:-8], _token(b'{"typ":"JWT"}'), _token(b"[1, 2, 3, 4]"),
             "Encyclopaedia.example.org", "C" * 64, "deadbeef" * 8, "-----BEGIN KEY-----\nabc\n-----END KEY-----"]
    assert [_found(t, DER, SSH, JWT) for t in texts] == [[]] * len(texts)


@pytest.mark.parametrize("piece", ["A" * 64 + "\n", "A", "eyJhbGci", "-----BEGIN A-----", "-----BEGIN A-----\nA: b\n", "eyJhbGciOiJI.", "\\n", "MIIB\\n", "a: "])
def test_long_texts_take_linear_time(piece):
    begun = time.perf_counter()
    spans(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - begun < 5


def test_over_rows_like_one_by_one(spark):
    texts = [None, "", "nothing here", "see\n" + "\n".join(LINES), f"Bearer {_token(b' {' + json.dumps('alg').encode() + b': ' + b'1}')}",
             f"Bearer {_token(b' ' + json.dumps({'alg': 'HS256'}).encode())}", "\\n" + "\\n".join(LINES), SSH_KEY, SSH_KEY]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, secrets string")
    got = {r.doc_id: [tuple(x) for x in r.secrets] for r in find_secrets(docs).collect()}
    names = ("assign", "access", "hex", "der", "ssh", "jwt")
    assert got == {i: [(names[k], a, b) for a, k, b in spans(t or "")] for i, t in enumerate(texts)}
    assert [bool(got[i]) for i in range(len(texts))] == [False, False, False, True, False, True, True, True, True]
