import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from shelfcast.llm.bpe import bpe_digest, encoded, merger
from shelfcast.llm.merges import LONG_SLICE
from shelfcast.llm.pretokens import slices
from shelfcast.llm.textgrid import byte_array

from . import hard_cases as H
from .test_repair import ODD


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=600, seed=3):
    rng = random.Random(seed)
    signs = ["'", "s", "t", "re", "ve", "l", "l", "d", "m", " ", " ", "\n", "\t", "a", "B", "é", "1", "٣", "!", "-", "日", " ", " ", "́", "😀", "'ll", "\r", "\x1c", "ſ"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


TEXTS = [*ODD, *H.texts(), *random_texts(), "it's they're 'twas ''s '''re x'll'd", "=" * 1000, " " * 700 + "x", "ab" * 3000, "a" * (LONG_SLICE + 1), "日本語" * 300, "'", "x'", "'r", "\n\n'll"]


def test_ids_equal_the_library():
    enc = library()
    ids, bounds = merger().encode(*byte_array(pa.array(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == enc.encode_ordinary(t or ""), repr(t)[:200]


def test_one_text_over_many_blocks():
    text = "".join(random_texts(900, 7))
    ids, _ = merger().encode(*byte_array(pa.array([text])))
    assert ids.tolist() == library().encode_ordinary(text)


def test_slices_cover_the_text():
    data, offsets = byte_array(pa.array(["it's  me", None, "x"]))
    starts, ends = slices(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"it", b"'s", b" ", b" me", b"x"]


def test_whole_tables(spark):
    frame, enc = H.with_odd_rows(spark, H.docs(spark, TEXTS)).repartition(3), library()
    want = []
    for r in frame.collect():
        ids, sha = enc.encode_ordinary(r["text"] or ""), lambda b: hashlib.sha256(b).hexdigest()
        want.append((str(r["doc_id"]), len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    got = [(str(r[0]), *r[1:]) for r in bpe_digest(frame).collect()]
    assert sorted(got) == sorted(want)
    assert bpe_digest(frame.limit(0)).count() == 0


def test_offsets_point_at_tokens(spark):
    enc = library()
    for r in encoded(H.docs(spark, TEXTS[:60])).collect():
        text = (r["row"]["text"] or "").encode()
        for i, (token, at) in enumerate(zip(r["ids"], r["offsets"])):
            end = r["offsets"][i + 1] if i + 1 < len(r["ids"]) else len(text)
            assert text[at:end] == enc.decode_single_token_bytes(token)
