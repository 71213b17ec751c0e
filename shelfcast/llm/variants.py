"""Spelling variants: words one code point apart, each led to its most frequent neighbour.

Words are counted over all texts, some with a letter dropped as the contract says. Near words are found by a bit-sliced
position index: for every position and letter a bitset over a slice of the vocabulary. Along a query word, the set of words without an error
(Z), with one replaced letter (S) and with one more letter, read at the shifted position (I), are carried on together:

    M = Z & ~B[p][c]    S = S & B[p][c] | M    I = (I | M) & B[p + 1][c]    Z = Z & B[p][c]

M has the words whose first difference is at p. Queries of length m look for words of lengths m and m + 1; the latter learn of the former by the same pair.
Slices: a difference lies in one half of a word, so pairs share the other half. Words are dealt by that half,
for both halves and both lengths; only first differences in the open half count, so each pair is found once. A slice of more
than SPLIT words is dealt anew by halves of its open part, down to a single position, where at most
90 + 90 * 90 words of two lengths can differ. No pair leaves a task, only a word's count and best neighbour.

A word's form is its near word of largest count (ties: smallest), if that is ``times`` its own or more; forms are followed to the root
downwards from the roots, level by level (counts grow along a chain, so levels are few).

A word's letters are looped over, so one of a million letters takes seconds. Null texts have no words; a null doc_id is the empty text in the contract's hash; repeated rows count each. No word gives no row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .textgrid import byte_array, kept, lower_ascii, sliced

DROP_EVERY = 97  # fixed by the contract
TEXT_BYTES = 8 << 20
SPLIT, BATCH_WORDS, BATCH_LETTERS, CELLS = 16_384, 4096, 1 << 22, 1 << 19
SHORT = 64


def only_letters(col: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and a space for every byte outside a-z and U+00C0-U+00FF."""
    data, offsets = byte_array(col)
    data = lower_ascii(data)
    solid = ((data >= 97) & (data <= 122)) | (data == 0xC3)
    solid[1:] |= data[:-1] == 0xC3  # the second byte of U+00C0-U+00FF
    data = np.where(solid, data, np.uint8(32))
    return pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def shift_table(n: int) -> np.ndarray:
    """What n more bytes make of a crc32, as four tables of its bytes (a crc is linear)."""
    zeros = bytes(n)
    none = zlib.crc32(zeros)
    return np.array([[zlib.crc32(zeros, b << (8 * k)) ^ none for b in range(256)] for k in range(4)], np.uint32)


def joined_crc(before: np.ndarray, words: list[bytes], index: np.ndarray) -> np.ndarray:
    """crc32 of a first part, given by its crc, and words[index]."""
    sizes, own = np.array([len(w) for w in words], np.int64), np.array([zlib.crc32(w) for w in words], np.uint32)
    out, size = np.empty(len(index), np.uint32), sizes[index]
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        c = before[at]
        if n <= SHORT:
            t = kept(f"crc shift {n}", lambda: shift_table(n))
            out[at] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24] ^ own[index[at]]
        else:
            out[at] = [zlib.crc32(words[i], x) for i, x in zip(index[at].tolist(), c.tolist())]
    return out


def counted_runs(doc_ids: list, texts: pa.Array, least_points: int, drop_every: int | None) -> tuple[pa.Array, np.ndarray]:
    """Different words of at least ``least_points`` code points and their counts in these texts."""
    lists = pc.ascii_split_whitespace(only_letters(texts))
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    words = coded.dictionary
    if len(words) == 0:
        return words, np.zeros(0, np.int64)
    key, times = np.unique(row * len(words) + coded.indices.to_numpy(), return_counts=True)
    row, index = np.divmod(key, len(words))
    dropped: Counter[str] = Counter()
    whole = np.ones(len(key), bool)
    if drop_every:
        before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids], np.uint32)
        h = joined_crc(before[row], [w.encode() for w in words.to_pylist()], index)
        whole = h % np.uint32(drop_every) != 0
        for i, x, n in zip(index[~whole].tolist(), h[~whole].tolist(), times[~whole].tolist()):
            w = words[i].as_py()
            at = x % len(w)
            dropped[w[:at] + w[at + 1:]] += n
    counts = np.bincount(index[whole], times[whole], len(words)).astype(np.int64)
    words = pa.concat_arrays([words, pa.array(list(dropped), pa.large_string())])
    counts = np.concatenate([counts, np.array(list(dropped.values()), np.int64)])
    stay = (counts > 0) & (pc.utf8_length(words).to_numpy() >= least_points)
    return words.filter(pa.array(stay)), counts[stay]


def word_counts(docs: DataFrame, least_points: int = 5, least_count: int = 3, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, size=TEXT_BYTES):
            words, counts = counted_runs(b.column("doc_id").to_pylist(), b.column("text"), least_points, drop_every)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(counts)], ["word", "n"])

    found = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, "word string, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")


def slices(vocabulary: DataFrame, least_points: int = 5, split: int = SPLIT) -> DataFrame:
    """Words dealt to slices: (bucket, m, a, b, word, n). In a slice words have m or m + 1 code points, and equal ones before a and in the last m - b."""
    size = F.length("word")
    m = F.explode(F.when(size > least_points, F.array(size - 1, size)).otherwise(F.array(size)))

    def dealt(rows: DataFrame) -> DataFrame:
        first, last = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - F.col("m") + F.col("b") + 1, F.col("m"))
        return rows.withColumn("bucket", F.xxhash64("m", "a", "b", first, last))

    def halves(rows: DataFrame) -> DataFrame:
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        part = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))
        return dealt(rows.withColumn("part", part).select("word", "n", "m", F.col("part.a").alias("a"), F.col("part.b").alias("b")))

    rows = halves(vocabulary.select("word", "n", m.alias("m")).withColumns({"a": F.lit(0), "b": F.col("m")}))
    done = None
    while True:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("b") - F.col("a")).alias("open"))
        rows = written(rows, "variant-slices")
        large = written(sizes.where((F.col("size") > split) & (F.col("open") > 1)).select("bucket"), "large-slices")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "bucket", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = halves(rows.join(large, "bucket"))


class PositionIndex:
    """Bitsets over words of m or m + 1 letters: ``bits[p][c]`` has the words with letter c at place p."""

    def __init__(self, letters: np.ndarray, long: np.ndarray, group: np.ndarray) -> None:
        """``letters``: m + 1 small codes a word; ``long``: it has m + 1 letters; ``group``: ordinal of its slice, ascending."""
        n, width = letters.shape
        self.n, self.m, self.letters, self.group = n, width - 1, letters, group
        self.wide = -(-n // 64) * 64
        alphabet = int(letters.max()) + 1
        self.bits = np.empty((width, alphabet, self.wide // 64), np.uint64)
        for p in range(width):
            there = letters[:, p] if p < self.m else np.where(long, letters[:, p], -1)
            self.bits[p] = self.packed(there, alphabet)
        self.long = self.packed(np.where(long, 0, -1), 1)[0]
        self.own = self.packed(group, int(group.max()) + 1)

    def packed(self, value: np.ndarray, kinds: int) -> np.ndarray:
        """Per kind the bitset of words with that value; negative values are none."""
        out = np.zeros((kinds, self.wide // 8), np.uint8)
        at = np.flatnonzero(value >= 0)
        np.bitwise_or.at(out, (value[at], at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        return out.view(np.uint64)

    def near(self, queries: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs one letter apart whose first difference lies in [a, b) of the query, or at m if b is m."""
        block = max(1, CELLS // self.bits.shape[2])
        for lo in range(0, len(queries), block):
            q, first, last = queries[lo:lo + block], a[lo:lo + block], b[lo:lo + block]
            z = self.own[self.group[q]]
            s, i = np.zeros_like(z), np.zeros_like(z)
            for p in range(self.m):
                c = self.letters[q, p]
                hit = self.bits[p][c]
                here = z & ~hit
                here[(p < first) | (p >= last)] = 0
                i |= here
                i &= self.bits[p + 1][c]
                s &= hit
                s |= here
                z &= hit
            z[last < self.m] = 0
            found = (s & ~self.long) | ((i | z) & self.long)
            row, cell = np.nonzero(found)
            bit = (found[row, cell][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            at, j = np.nonzero(bit)
            yield q[row[at]], cell[at] * 64 + j


def letter_codes(words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words' letters, one row each, padded with 0; the words' lengths. Codes count the letters that occur."""
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    data, _ = byte_array(words)
    lead = (data & 0xC0) != 0x80
    points = data[lead].astype(np.int64)
    two = points == 0xC3
    points[two] = 0xC0 + (data[np.flatnonzero(lead)[two] + 1] & 0x3F)
    seen = np.unique(points)
    out = np.zeros((len(words), width), np.int16)
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.searchsorted(seen, points)
    return out, sizes


def told(words: pa.Array, n: np.ndarray, m: int, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Near words within each slice: per word that has one, how many and the best."""
    letters, sizes = letter_codes(words, m + 1)
    index = PositionIndex(letters, sizes == m + 1, group)
    short = np.flatnonzero(sizes == m)
    pairs = list(index.near(short, a[short], b[short]))
    one, other = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    mirrored = sizes[other] == m + 1  # words of m letters ask for themselves
    one, other = np.concatenate([one, other[mirrored]]), np.concatenate([other, one[mirrored]])
    if len(one) == 0:
        return None
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    who, start, count = np.unique(one, return_index=True, return_counts=True)
    best = other[start]
    return pa.RecordBatch.from_arrays([words.take(pa.array(who)), pa.array(count.astype(np.int64)), pa.array(n[best]), words.take(pa.array(best))],
                                      ["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, least_points: int = 5, split: int = SPLIT) -> DataFrame:
    """Per word with a near one: (word, n_near, best, best_n)."""
    rows = slices(vocabulary, least_points, split)
    rows = rows.repartition("bucket").sortWithinPartitions("m", "bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole slices of one m, and the rows of the slice that goes on
        n_held, now = 0, None

        def closed(part: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(part).combine_chunks()
            words = pa.concat_arrays([b.column("word") for b in part])
            bucket = t["bucket"].to_numpy()
            group = np.cumsum(np.append(False, bucket[1:] != bucket[:-1]))
            if len(words) == group[-1] + 1:
                return None  # every word is alone in its slice
            return told(words, t["n"].to_numpy(), t["m"][0].as_py(), group, t["a"].to_numpy(), t["b"].to_numpy())

        for b in batches:
            if b.num_rows == 0:
                continue
            m, bucket = b.column("m").to_numpy(), b.column("bucket").to_numpy()
            new = np.append((m[0], bucket[0]) != now, (bucket[1:] != bucket[:-1]) | (m[1:] != m[:-1]))
            now = (m[-1], bucket[-1])
            lo = 0
            for at in np.flatnonzero(new).tolist():
                full = n_held + at - lo >= min(BATCH_WORDS, max(1, BATCH_LETTERS // int(m[at]) + 1))
                before = int(m[at - 1]) if at > lo else held[-1].column("m")[-1].as_py() if held else None
                if before is not None and (full or before != m[at]):
                    out = closed([*held, b.slice(lo, at - lo)] if at > lo else held)
                    held, n_held, lo = [], 0, at
                    if out is not None:
                        yield out
            held.append(b.slice(lo))
            n_held += b.num_rows - lo
        if held and (out := closed(held)) is not None:
            yield out

    found = rows.mapInArrow(work, "word string, n_near long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("lead"))
            .select("word", "n_near", F.col("lead.best").alias("best"), (-F.col("lead.col1")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, from the roots down. A word is the form of a bounded number of near words, so no key is hot."""
    edges = forms.select("word", "form")
    level = written(edges.join(edges.select(F.col("word").alias("form")), "form", "left_anti").select("word", F.col("form").alias("root")), "variant-roots")
    out = level
    while not level.isEmpty():
        above = level.select(F.col("word").alias("form"), "root")
        level = written(edges.join(above, "form").select("word", "root"), "variant-roots")
        out = out.unionByName(level)
    return out


def spelling_groups(docs: DataFrame, least_points: int = 5, least_count: int = 3, times: int = 2, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocabulary = word_counts(docs, least_points, least_count, drop_every)
    near = near_words(vocabulary, least_points)
    leads = F.col("best_n") >= times * F.col("n")
    rows = written(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n")), "variant-forms")
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
