"""Signed tokens whose header has white space after its brace."""

import base64
import json

import pytest

from rastrum.llm import secrets


@pytest.mark.parametrize("lead", ["{", "{ ", "{\n ", "{\r\n", "{\t"])
def test_tokens_with_spaced_headers(lead):
    code = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    token = ".".join([code(lead + json.dumps({"alg": "HS256", "typ": "JWT"})[1:]), code("{ " + json.dumps({"sub": "1234567890", "name": "Jo"})[1:]), code("s" * 32)])
    text = f"see {token} here"
    assert any(kind == "jwt" and text[s:e] == token for s, e, kind in secrets.confirmed(text, text.encode()))
