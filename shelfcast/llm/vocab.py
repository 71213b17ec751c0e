"""Token ids as the tokenizers library gives them, made once for each different stretch of text.

Texts are cut where the tokenizer's own pre-tokenisation must cut, whatever stands around: so a text's
ids are those of its stretches in order. Stretches are told apart by a 64-bit hash of their bytes, and the ids
of those seen before come from a table of bounded size. The vocabulary file is read where tasks run.
"""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers

from .merges import PairMerges
from .pretokens import slices
from .stretches import StretchTable
from .textgrid import kept, word_bounds

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
DOTTED = "\u0130".encode()  # its lower case is longer


def plain_table() -> np.ndarray:
    """Bytes of printable ASCII but the space, and of U+00C0-U+017F."""
    table = np.zeros(256, bool)
    table[[*range(33, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
    return table


def word_stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokenizers that drop white space: runs without ASCII white space."""
    return word_bounds(data, offsets)[:2]


def led_stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For byte-level BPE, whose words take a leading space: cut before a space or line feed with something solid
    behind it, and after such a line feed. Solid here: ASCII signs and U+00C0-U+07FF, none of them white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ((data > 0x20) & (data < 0x7F)) | ((data >= 0xC3) & (data <= 0xDF))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    led = solid[1:] & ~edge[1:]  # a solid sign follows in the same text
    feed = (data == 10) & led
    cut = edge.copy()
    cut[:-1] |= ((data == 32) & led) | feed
    cut[1:] |= feed
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(data))


def byte_signs() -> list[str]:
    """The sign that stands for each byte in vocabulary files: itself where printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Vocabulary(StretchTable):
    """Encodes texts with one vocabulary file.

    New stretches of plain signs (ASCII and Latin letters to U+017F, which no normal form changes) are cut by the
    automaton of pretokens and merged together; the library encodes all others, one by one.
    """

    def __init__(self, path: str, words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.words = Tokenizer.from_file(path), words
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, close = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b, into = (np.array([vocabulary[x] for x in col], np.int64) for col in zip(*((a, b, a + b) for a, b in pairs)))
        self.merges = PairMerges(a, b, np.arange(len(pairs)), into)
        self.inner, self.last = (np.array([vocabulary[c + end] for c in byte_signs()], np.int64) for end in ("", close))
        super().__init__()

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw, lengths = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(lengths) - lengths
        odd = ~kept("plain bytes", plain_table)[raw]
        odd[begin[raw[begin] == 32]] = False  # a leading space
        odd[:-1] |= (raw[:-1] == DOTTED[0]) & (raw[1:] == DOTTED[1])
        plain = np.add.reduceat(odd.astype(np.int32), begin) == 0
        data, bounds = raw[np.repeat(plain, lengths)], np.append(0, np.cumsum(lengths[plain]))
        if self.words:
            data = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
        starts, ends = slices(data, bounds, self.words)
        first = self.inner[data]
        first[ends - 1] = self.last[data[ends - 1]]
        ids, sizes = self.merges.merge(first, ends - starts)
        upto = np.append(0, np.cumsum(sizes))
        sizes = np.diff(upto[np.searchsorted(starts, bounds)])
        if plain.all():
            return ids, sizes
        other = [e.ids for e in self.library.encode_batch_fast([p.decode() for p, j in zip(pieces, plain.tolist()) if not j], add_special_tokens=False)]
        all_sizes = np.zeros(len(pieces), np.int64)
        all_sizes[plain], all_sizes[~plain] = sizes, [len(o) for o in other]
        out, of = np.zeros(int(all_sizes.sum()), np.int64), np.repeat(plain, all_sizes)
        out[of], out[~of] = ids, [x for o in other for x in o]
        return out, all_sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts among them."""
        starts, ends = (word_stretches if self.words else led_stretches)(data, offsets)
        ids, upto = self.encode_stretches(data, starts, ends)
        return ids, upto[np.searchsorted(starts, offsets)]


def byte_bpe(path: str | None = None) -> Vocabulary:
    path = path or public_tokenizers.path(BYTE_BPE)
    return kept(f"vocabulary {path}", lambda: Vocabulary(path, words=False))


def word_bpe(path: str | None = None) -> Vocabulary:
    path = path or public_tokenizers.path(WORD_BPE)
    return kept(f"vocabulary {path}", lambda: Vocabulary(path, words=True))


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end``."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
