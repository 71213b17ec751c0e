import hashlib
import re
import zlib

import pytest
from shelfcast.llm.secrets import DIGITS, KINDS, base62, masked, mask_secrets, secret_spans, secrets_digest

from . import hard_cases as H

# The base patterns, matched over the whole text.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def github(body="A" * 30):
    return "ghp_" + body + base62(zlib.crc32(body.encode()), 6)


CASES = ["password = hunter2hunter2", "Passwd:'short'", "TOKEN=abc secret: \"x\" api_key=ABCDEFGH12345", "é" * 9 + "apikey=12345678",
         "AKIAAKIAAKIA1234567 AKIA123", "f" * 31 + " " + "0a" * 16 + "g" + "1" * 40, "token=token=token=abcdefgh", "ſecret=abcdefghij İtoken=abcdefghij",
         "secret=" + "a1" * 20, "", " "]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_equal_whole_text_matching(text):
    assert [s for s in secret_spans(text) if s[2] in ("assign", "access", "hex")] == brute(text)


def test_checksums_decide():
    good = github()
    assert [s[2] for s in secret_spans(f"x {good} y")] == ["github"]
    assert secret_spans(good[:-1] + DIGITS[(DIGITS.index(good[-1]) + 1) % 62]) == []
    assert [s[2] for s in secret_spans("Card no 4111 1111 1111 1111 ok")] == ["card"]
    assert secret_spans("Card no 4111 1111 1111 1112 ok") == []
    assert [s[2] for s in secret_spans("IBAN: GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert secret_spans("IBAN: GB83 WEST 1234 5698 7654 32") == []
    assert [s[2] for s in secret_spans("eyJhbGciOiJIUzI1NiJ9.eyJ4IjoxfQ.abc")] == ["jwt"]


def test_mask_covers_overlaps_once():
    text = "a secret=" + "ab" * 20 + " b"
    assert masked(text, secret_spans(text)) == "a [secret] b"


def test_digest_over_hard_rows(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, [*H.texts(), *CASES]))
    got = secrets_digest(frame).collect()
    assert len(got) == frame.count()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in brute(r["text"] or "")).encode()).hexdigest())
                  for r in frame.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["base_sha256"]) for r in got) == want
    assert secrets_digest(frame.limit(0)).count() == 0


def test_masking_keeps_columns_and_clean_rows(spark):
    frame = H.docs(spark, ["clean text", None, "token=abcdefghijk end"])
    out = mask_secrets(frame)
    assert out.schema.names == frame.schema.names
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["text"] == "clean text" and rows[1]["text"] is None
    assert rows[2]["text"] == "[secret] end" and rows[2]["n_chars"] == len("[secret] end")
