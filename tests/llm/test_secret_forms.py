"""Key material in the forms in which it is pasted: escaped, with headers, wrapped."""

import base64
import json

from test_corpus_operators import der

from rastrum.llm import secrets

KEY = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(4, der(0x30, der(2, b"\0"), der(2, b"\x7f" * 128))))
B64 = base64.b64encode(KEY).decode()
LINES = [B64[k : k + 64] for k in range(0, len(B64), 64)]


def kinds(text):
    return [(k, text[s:e]) for s, e, k in secrets.confirmed(text, text.encode())]


def test_escaped_pem_in_json():
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(LINES) + "\n-----END PRIVATE KEY-----\n"
    text = json.dumps({"id": 1, "key": pem})
    assert ("pem", json.dumps(pem)[1:-3]) in kinds(text)
    assert any(k == "pem" for k, _ in kinds(pem.replace("\n", "\r\n")))


def test_pem_headers():
    blocks = base64.b64encode(bytes(range(64)) * 2).decode()
    text = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n{blocks}\n-----END RSA PRIVATE KEY-----"
    assert kinds(text)[0] == ("pem", text)
    assert kinds(text.replace("Proc-Type: 4,ENCRYPTED\n", "")) == []
    assert kinds(text.replace("END RSA", "END DSA")) == []


def test_wrapped_without_marks():
    text = "the key:\n    " + "\n    ".join(LINES) + "\nend"
    assert kinds(text) == [("der", "\n    ".join(LINES))]
    assert kinds(text.replace(LINES[1], LINES[1][:-2])) == []
    assert kinds("x " + "\\n".join(LINES)) == [("der", "\\n".join(LINES))]


def test_token_payload():
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    head, tail = part({"alg": "RS256", "typ": "JWT"}), "Ab3" * 14
    assert kinds(f"{head}.{part({'sub': 1})}.{tail}")[0][0] == "jwt" and kinds(f"{head}.{part(b'no object here')}.{tail}") == []
    assert kinds(f"{part({'alg': 'RS256'})}.{part(b'any bytes, signed')}.{tail}")[0][0] == "jwt"


def test_linear_in_marks_and_lines():
    for text in ("-----BEGIN A-----" * 50_000, ("A" * 64 + "\n") * 20_000, "-----BEGIN A-----x-----END B-----" * 20_000):
        assert [k for k, _ in kinds(text) if k != "hex"] == []
