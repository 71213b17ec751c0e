"""Secret scan: an Aho-Corasick automaton finds keywords, regular expressions are tried only where
one was hit, and spans with a built-in checksum must pass it.

Base kinds (the fixed patterns): ``assign``, ``access`` and ``hex``; per kind the leftmost matches
that don't overlap, too short ones dropped after matching. Added kinds, all of them validated:
``github`` and ``npm`` (36 characters, the last six the base-62 CRC-32 of those before), ``card``
(Luhn), ``iban`` (remainder 97), ``jwt`` (a header that decodes to JSON with "alg"), ``pem`` (a private
key's opening line). Hexadecimal runs have no keyword, so that pattern itself goes over the text.

Null and empty texts have no span. Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped, unpacked
from .textgrid import kept

# The base patterns and the shapes of public token formats.
PATTERNS = {
    "assign": r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "card": r"(?i:card)[^\n0-9]{0,24}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])",
    "iban": r"(?i:iban)[^\nA-Z0-9]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Z0-9])",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
}
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "card": "card", "iban": "iban", "eyj": "jwt", "-----begin ": "pem",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = list(PATTERNS)


def base62(value: int, width: int) -> str:
    out = ""
    for _ in range(width):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out


def crc_holds(m: re.Match) -> bool:
    body = m[0].split("_", 1)[1]
    return base62(binascii.crc32(body[:30].encode()), 6) == body[30:]


def luhn_holds(m: re.Match) -> bool:
    digits = [int(c) for c in m[1] if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[::-2]) + sum(doubled)) % 10 == 0 and len(set(digits)) > 1


def iban_holds(m: re.Match) -> bool:
    code = m[1].replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def header_holds(m: re.Match) -> bool:
    head = m[0].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


VALID: dict[str, Callable[[re.Match], bool]] = {
    "assign": lambda m: len(m[1]) >= 8, "access": lambda m: len(m[0]) >= 16, "github": crc_holds, "npm": crc_holds,
    "card": luhn_holds, "iban": iban_holds, "jwt": header_holds, "pem": lambda m: True,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    words = kept("secret keywords", automaton)
    patterns = kept("secret patterns", lambda: {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()})
    hits: dict[str, list[int]] = {}
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (size, kind) in words.iter(lower):
        hits.setdefault(kind, []).append(last + 1 - size)
    spans = [(m.start(), m.end(), "hex") for m in patterns["hex"].finditer(text)]
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start >= free and (m := patterns[kind].match(text, start)):
                free = m.end()
                if VALID[kind](m):
                    spans.append((m.start(), m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "[secret]") -> str:
    """The text with every stretch covered by spans replaced by one mask."""
    out, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` packed in ``row``; ``spans`` (start, end, kind) and ``masked``, the text without its secrets (null if none)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = b.column(0).slice(lo, 500)
                texts = [t or "" for t in pc.struct_field(rows, text).to_pylist()]
                found = [secret_spans(t) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    rows, pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f] for f in found], kind),
                    pa.array([masked(t, f) if f else None for t, f in zip(texts, found)], pa.string())], ["row", "spans", "masked"])

    return mapped(docs, work, "spans array<struct<start: long, end: long, kind: string>>, masked string")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = ("assign", "access", "hex")
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(1):
                spans = secret_spans(text.as_py() or "")
                said = lambda only: ",".join(f"{k}:{s}:{e}" for s, e, k in spans if not only or k in base)
                for to, value in zip(out, [*(sum(k == x for _, _, k in spans) for x in base),
                                           hashlib.sha256(said(True).encode()).hexdigest(), said(False)]):
                    to.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text")
            .mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked and n_chars (if there) counted anew; documents without stay as they are."""
    out = scan(docs)
    values = unpacked(docs)
    values["text"] = F.coalesce("masked", values["text"])
    if "n_chars" in values:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(F.col("masked").isNull(), values["n_chars"]).otherwise(F.length("masked").cast(kind))
    return out.select(*[v.alias(c) for c, v in values.items()])
