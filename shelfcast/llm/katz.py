"""Katz backoff bigram model, trained and scored over all documents.

Documents are cut into shards of a few million tokens, kept as files: per shard its different words' hashes and the tokens
as indexes into them. Counts are made by bucket of a word's hash: every shard sends its words once
with their local counts, so that no word is hot, and gets totals back. Pairs of neighbours go to their first word's bucket; a first
word with more than 1/1000 of all tokens (fewer than 1000 words) is spread over buckets by its second word.
Each bucket stores its part of the model tables and answers every shard that asked.

Good-Turing: counts r up to 5 keep the share d(r) of the mass, computed from the counts of counts. What a
context's seen words leave is given to the others in proportion to the next lower order, with a weight that
makes each context sum to exactly one. Unigrams leave their rest to one unknown word. A context that leaves nothing
is scaled to leave 1 / (its count + 1). Evaluation per token: the pair if seen, else the weight times the word, else the rest.

Null and empty texts are the end token alone. With no training tokens, every score is 0.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import opened, save
from .tables import new_folder, text_crc, written
from .textgrid import byte_array, lower_ascii, mixed, slice_hashes, sliced, word_bounds

MOST = 5  # counts up to this one are discounted
END_HASH = np.uint64(1)
SHARD_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS, HOT = 1_000_000, 1_000_000, 16, 1000


def packed(x: np.ndarray) -> bytes:
    """An array with its type, its bytes regrouped by significance and compressed."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str.encode().ljust(8) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:8].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def discounts(of: np.ndarray) -> np.ndarray:
    """d[0..MOST] from the counts of counts of[r]; for each r a share in (0, 1].

    With too few counts for Good-Turing at this limit, lower limits are tried, then d(r) = (r - 0.5) / r.
    """
    r = np.arange(MOST + 1)
    for k in range(MOST, 0, -1):
        if (of[1:k + 2] > 0).all():
            cut = (k + 1) * of[k + 1] / of[1]
            star = (np.arange(1, k + 1) + 1) * of[2:k + 2] / of[1:k + 1]
            if cut < 1:
                d = (star / np.arange(1, k + 1) - cut) / (1 - cut)
                if ((d > 0) & (d <= 1)).all():
                    return np.concatenate([[1.0], d, np.ones(MOST - k)])
    return np.where(r > 0, (r - 0.5) / np.maximum(r, 1), 1.0)


@dataclass(frozen=True)
class Unigrams:
    """Probabilities of words from their counts; ``rest`` is the unknown word's."""

    tokens: int
    distinct: int
    d: np.ndarray
    rest: float
    scale: float

    @staticmethod
    def of(tokens: int, distinct: int, counts_of: np.ndarray) -> Unigrams:
        d = discounts(counts_of)
        r = np.arange(1, MOST + 1)
        rest = float((counts_of[1:MOST + 1] * r * (1 - d[1:])).sum() / tokens) if tokens else 1.0
        floor = rest if rest > 1e-9 else 1 / (tokens + 1)
        return Unigrams(tokens, distinct, d, floor, 1.0 if rest > 1e-9 else 1 - floor)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Of words with these counts; count 0 is the unknown word."""
        return np.where(c > 0, np.where(c > MOST, 1.0, self.d[np.minimum(c, MOST)]) * c / max(self.tokens, 1) * self.scale, self.rest)


class Shard:
    """Documents as indexes into their sorted word hashes."""

    def __init__(self, doc_ids: pa.Array, held: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> None:
        self.doc_ids, self.held, self.sizes, self.tokens, self.words = doc_ids, held, sizes, tokens, words

    def parts(self) -> list[bytes]:
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": self.doc_ids})
        with pa.ipc.new_stream(sink, table.schema) as to:
            to.write_table(table)
        parts = [sink.getvalue().to_pybytes(), *map(packed, (self.held, self.sizes, self.tokens, self.words))]
        return [struct.pack("<5Q", *map(len, parts)), *parts]

    @staticmethod
    def load(folder: str, file: str) -> Shard:
        fs, path = opened(folder)
        with fs.open_input_stream(f"{path}/{file}") as stream:
            raw = stream.read()
        cuts = np.cumsum([40, *struct.unpack("<5Q", raw[:40])]).tolist()
        parts = [raw[a:z] for a, z in zip(cuts, cuts[1:])]
        return Shard(pa.ipc.open_stream(parts[0]).read_all()["doc_id"].combine_chunks(), *map(unpacked, parts[1:]))

    def training(self) -> np.ndarray:
        """Per token: it may be learned from."""
        return np.repeat(~self.held.astype(bool), self.sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training()], minlength=len(self.words))


def write_shards(docs: DataFrame, held: Column, folder: str) -> DataFrame:
    """(shard, file, n_tokens, n_train, n_train_docs) of each shard's file."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate([k[3] for k in kept]), return_inverse=True)
            shard = Shard(pa.concat_arrays([k[0] for k in kept]), np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept]), tokens.astype(np.uint32), words)
            kept.clear()
            file = save(folder, ".tokens", shard.parts())
            learned = ~shard.held.astype(bool)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([file]), pa.array([len(tokens)], pa.int64()), pa.array([int(shard.sizes[learned].sum())], pa.int64()),
                                               pa.array([int(learned.sum())], pa.int64())], ["shard", "file", "n_tokens", "n_train", "n_train_docs"])

        for b in sliced(batches):
            data, offsets = byte_array(b.column("text"))
            data = lower_ascii(data)
            starts, ends, bounds = word_bounds(data, offsets)
            h = np.maximum(slice_hashes(data, starts, ends), END_HASH + np.uint64(1))
            kept.append((b.column("doc_id"), b.column("held").to_numpy(zero_copy_only=False).astype(np.uint8), (np.diff(bounds) + 1).astype(np.uint32), np.insert(h, bounds[1:], END_HASH)))
            size += len(kept[-1][3])
            if size >= SHARD_TOKENS:
                yield flush()
                size = 0
        if kept:
            yield flush()

    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), held.alias("held"))
    return written(rows.mapInArrow(work, "shard string, file string, n_tokens long, n_train long, n_train_docs long"), "lm-shards")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that sorted words are in order of their buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts_of(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of a sorted array."""
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)]))


def counted(shards: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Totals of words: per bucket and shard the answer (``totals``, ``index``), and per bucket the table part
    (shard null: ``words``, ``totals``, ``n_words``, ``n_of``)."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard.load(folder, file)
                counts, cuts = s.word_counts(), cuts_of(bucket_of(s.words, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int32()), pa.array([shard] * len(cuts)), pa.array([packed(s.words[a:z]) for _, a, z in cuts]),
                                                  pa.array([packed(narrow(counts[a:z])) for _, a, z in cuts])], ["bucket", "shard", "words", "counts"])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        words, counts = [unpacked(x.as_py()) for x in t["words"]], [unpacked(x.as_py()) for x in t["counts"]]
        all_words, at = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts).astype(np.float64), len(all_words)).astype(np.uint64)
        known = totals > 0
        index, cuts = np.cumsum(known) - known, np.cumsum([0, *map(len, words)])
        own = [at[a:z] for a, z in zip(cuts, cuts[1:])]
        n, none = len(own), [None]
        of = np.bincount(np.minimum(totals[known], MOST + 2).astype(np.int64), minlength=MOST + 3)
        return pa.table({"bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "shard": pa.array([*t["shard"].to_pylist(), None], pa.string()),
                         "totals": pa.array([*(packed(narrow(totals[o])) for o in own), packed(narrow(totals[known]))]), "index": pa.array([*(packed(index[o].astype(np.uint32)) for o in own), None], pa.binary()),
                         "words": pa.array(none * n + [packed(all_words[known])], pa.binary()), "n_words": pa.array(none * n + [int(known.sum())], pa.int64()),
                         "n_of": pa.array(none * n + [of[:MOST + 2].tolist()], pa.list_(pa.int64()))})

    rows = spread(shards.select("shard", "file")).mapInArrow(ask, "bucket int, shard string, words binary, counts binary")
    return written(rows.groupBy("bucket").applyInArrow(answer, "bucket int, shard string, totals binary, index binary, words binary, n_words long, n_of array<long>"), "lm-words")


def spread(shards: DataFrame) -> DataFrame:
    """A task for every few shards."""
    return shards.repartition(max(1, shards.count()))


def summed(table: DataFrame) -> np.ndarray:
    """The counts of counts over all buckets."""
    row = table.where("shard is null").agg(*[F.sum(F.col("n_of")[r]).alias(f"n{r}") for r in range(MOST + 2)]).first()
    return np.array([x or 0 for x in row], np.float64)


def with_answers(shards: DataFrame, words: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Each shard's file and answers as rows that follow each other: the file, its words by bucket, its pairs by bucket."""
    none, raw = F.lit(None).cast("string"), F.lit(None).cast("binary")
    rows = shards.select("shard", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "file", raw.alias("a"), raw.alias("b"))
    told = [(1, words, "index")] + ([(2, pairs, "sums")] if pairs is not None else [])
    for kind, table, second in told:
        rows = rows.unionByName(table.where("shard is not null").select("shard", F.lit(kind).alias("kind"), "bucket", none.alias("file"), F.col("totals").alias("a"), F.col(second).alias("b")))
    return rows.repartition(max(1, shards.count()), "shard").sortWithinPartitions("shard", "kind", "bucket")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list, list]]:
    """(shard, file, its words' answers, its pairs' answers), one shard at a time."""
    held: tuple | None = None
    for b in batches:
        for shard, kind, file, first, second in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "file", "a", "b"))):
            if kind == 0:
                if held:
                    yield held
                held = (shard, file, [], [])
            else:
                held[1 + kind].append((first, second))
    if held:
        yield held


@dataclass(frozen=True)
class Plan:
    """What tasks know of the whole corpus."""

    buckets: int
    index_bits: int
    unigrams: Unigrams
    train_docs: int

    def hot(self, c: np.ndarray) -> np.ndarray:
        return c > max(self.unigrams.tokens // HOT, 1)


class Pairs:
    """A shard's different pairs of known neighbours, in order of bucket, first and second word."""

    def __init__(self, shard: Shard, told: list, plan: Plan) -> None:
        n, tokens = len(shard.words), shard.tokens.astype(np.int64)
        self.totals = np.concatenate([np.zeros(0, np.int64), *(unpacked(x).astype(np.int64) for x, _ in told)])
        index = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x).astype(np.uint64) for _, x in told)])
        bucket = bucket_of(shard.words, plan.buckets)
        start = plan.buckets << plan.index_bits  # the id of a text's start, which is a context only
        ids = np.append((bucket.astype(np.uint64) << np.uint64(plan.index_bits)) | index, np.uint64(start))
        self.context_totals = np.append(self.totals, plan.train_docs)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(shard.sizes.astype(np.int64)) - shard.sizes] = n
        self.before, self.tokens = before, tokens
        self.usable = (self.totals[tokens] > 0) & (self.context_totals[before] > 0)
        keys, at = np.unique(before[self.usable] * (n + 1) + tokens[self.usable], return_inverse=True)
        first, second = keys // (n + 1), keys % (n + 1)
        counts = np.bincount(at[shard.training()[self.usable]], minlength=len(keys))
        hot = plan.hot(self.context_totals[first])
        hot |= first == n
        home = np.where(hot, bucket_of(mixed(shard.words[second] ^ np.uint64(0x5851F42D4C957F2D)), plan.buckets), np.append(bucket, 0)[first])
        order = np.argsort(home, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.at, self.first, self.second, self.home = place[at], first[order], second[order], home[order]
        self.counts = counts[order]
        # contexts: a row per bucket and first word; those without a pair of known words still need their weight
        run = np.flatnonzero(np.append(True, (self.first[1:] != self.first[:-1]) | (self.home[1:] != self.home[:-1]))) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.append(run, len(order)))
        seen = np.zeros(n + 1, bool)
        seen[before] = True
        seen &= (self.context_totals > 0) & ~plan.hot(self.context_totals)
        seen[n] = False
        seen[self.first] = False
        alone = np.flatnonzero(seen)
        of, where = np.append(self.first[run], alone), np.append(self.home[run], bucket[alone])
        by = np.lexsort((of, where))
        self.context, self.context_home, self.context_size = of[by], where[by], np.append(size, np.zeros(len(alone), np.int64))[by]
        self.context_hot = plan.hot(self.context_totals[self.context]) | (self.context == n)
        self.context_ids, self.second_ids = ids[self.context], ids[self.second]
        self.ids = ids

    def requests(self) -> Iterator[tuple]:
        """Per bucket: ids of contexts, which are spread, pairs of each, ids of their second words, training counts, totals of the second words."""
        pairs = {bucket: (a, z) for bucket, a, z in cuts_of(self.home)}
        for bucket, lo, hi in cuts_of(self.context_home):
            a, z = pairs.get(bucket, (0, 0))
            yield (bucket, packed(self.context_ids[lo:hi]), packed(self.context_hot[lo:hi].astype(np.uint8)), packed(self.context_size[lo:hi].astype(np.uint32)),
                   packed(narrow(self.second_ids[a:z])), packed(narrow(self.counts[a:z])), packed(narrow(self.totals[self.second[a:z]])))


def pair_keys(first: np.ndarray, second: np.ndarray, limit: int) -> np.ndarray:
    """A number per pair of ids below ``limit``, equal only for equal pairs: the ids side by side or, if they are too wide, their ranks here."""
    if limit < 1 << 32:
        return (first << np.uint64(32)) | second
    ids, rank = np.unique(second, return_inverse=True)
    return np.unique(first, return_inverse=True)[1].astype(np.uint64) * np.uint64(len(ids)) + rank.astype(np.uint64)


SUMS = 2 + MOST  # per context: mass of seen words' unigrams, numbers of pairs by count up to MOST, tokens of the others


def paired(shards: DataFrame, words: DataFrame, folder: str, plan: Plan) -> DataFrame:
    """Totals of pairs: per bucket and shard the answer (``totals`` of its pairs, ``sums`` of its contexts), and per
    bucket the table part (shard null: ``first``, ``second``, ``totals``, ``n_of``; ``hot``, ``sums``: of spread contexts)."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, file, told, _ in by_shard(batches):
            made = list(Pairs(Shard.load(folder, file), told, plan).requests())
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([shard] * len(made), pa.string()), *(pa.array([m[i] for m in made], pa.binary()) for i in range(1, 7))],
                                             ["bucket", "shard", "firsts", "spread", "sizes", "seconds", "counts", "worth"])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        cols = [[unpacked(x.as_py()) for x in t[c]] for c in ("firsts", "seconds", "spread", "sizes", "counts", "worth")]
        firsts, seconds, away, sizes, counts, worth = (np.concatenate(c) for c in cols)
        firsts, first = firsts.astype(np.uint64), np.repeat(firsts.astype(np.uint64), sizes)
        pair = pair_keys(first, seconds.astype(np.uint64), (plan.buckets + 1) << plan.index_bits)
        _, some, at = np.unique(pair, return_index=True, return_inverse=True)
        totals = np.bincount(at, counts.astype(np.float64), len(some)).astype(np.int64)
        seen = totals > 0
        contexts, of = np.unique(firsts, return_inverse=True)
        own = np.searchsorted(contexts, first[some])[seen]
        c = totals[seen]
        sums = np.zeros((len(contexts), SUMS))
        sums[:, 0] = np.bincount(own, plan.unigrams.p(worth[some][seen].astype(np.int64)), len(contexts))
        for r in range(1, MOST + 1):
            sums[:, r] = np.bincount(own[c == r], minlength=len(contexts))
        sums[:, SUMS - 1] = np.bincount(own[c > MOST], c[c > MOST], len(contexts))
        n_of = np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3)[:MOST + 2]
        hot = np.zeros(len(contexts), bool)
        hot[of[away > 0]] = True
        pair_cuts, context_cuts = np.cumsum([0, *map(len, cols[1])]), np.cumsum([0, *map(len, cols[0])])
        n, none = t.num_rows, [None]
        return pa.table({"bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "shard": pa.array([*t["shard"].to_pylist(), None], pa.string()),
                         "totals": pa.array([*(packed(narrow(totals[at[a:z]])) for a, z in zip(pair_cuts, pair_cuts[1:])), packed(narrow(c))]),
                         "sums": pa.array([*(packed(sums[of[a:z]].ravel()) for a, z in zip(context_cuts, context_cuts[1:])), packed(sums[hot].ravel())]),
                         "first": pa.array(none * n + [packed(first[some][seen])], pa.binary()), "second": pa.array(none * n + [packed(narrow(seconds[some][seen]))], pa.binary()),
                         "hot": pa.array(none * n + [packed(contexts[hot])], pa.binary()), "n_of": pa.array(none * n + [n_of.tolist()], pa.list_(pa.int64()))})

    rows = with_answers(shards, words).mapInArrow(ask, "bucket int, shard string, firsts binary, spread binary, sizes binary, seconds binary, counts binary, worth binary")
    return written(rows.groupBy("bucket").applyInArrow(answer, "bucket int, shard string, totals binary, sums binary, first binary, second binary, hot binary, n_of array<long>"), "lm-pairs")


def spread_sums(pairs: DataFrame) -> dict[int, np.ndarray]:
    """The sums of spread contexts over all buckets: fewer than HOT + 1 of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hot, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = unpacked(sums).reshape(-1, SUMS)
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(hot).astype(np.int64)), *(pa.array(rows[:, i]) for i in range(SUMS))], ["id", *(f"s{i}" for i in range(SUMS))])

    rows = pairs.where("shard is null").select("hot", "sums").mapInArrow(work, "id long, " + ", ".join(f"s{i} double" for i in range(SUMS)))
    found = rows.groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUMS)]).collect()
    return {r["id"]: np.array(r[1:]) for r in found}


def weights(sums: np.ndarray, totals: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: the weight of the lower order, and the scale of its seen pairs."""
    kept = (sums[:, 1:MOST + 1] * (d[1:] * np.arange(1, MOST + 1))).sum(1) + sums[:, SUMS - 1]
    kept = kept / np.maximum(totals, 1)
    none_left = kept > 1 - 1e-9
    left = np.where(none_left, 1 / (totals + 1), 1 - kept)
    scale = np.where(none_left, (1 - left) / np.maximum(kept, 1e-300), 1.0)
    return left / np.maximum(1 - sums[:, 0], 1e-300), scale


def scored(docs: DataFrame, held: Column) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    folder = new_folder(spark, "lm-tokens")
    shards = write_shards(docs, held, folder)
    size = shards.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("train"), F.sum("n_train_docs").alias("docs")).first()
    buckets = max(LEAST_BUCKETS, -(-(size["all"] or 0) // BUCKET_TOKENS))
    words = counted(shards, folder, buckets)
    told = words.where("shard is null").agg(F.sum("n_words").alias("distinct"), F.max("n_words").alias("most")).first()
    unigrams = Unigrams.of(size["train"] or 0, told["distinct"] or 0, summed(words))
    plan = Plan(buckets, max(1, int(told["most"] or 1).bit_length()), unigrams, size["docs"] or 0)
    pairs = paired(shards, words, folder, plan)
    d, hot = discounts(summed(pairs)), spread_sums(pairs)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = unigrams.tokens, unigrams.distinct
        for _, file, told, own in by_shard(batches):
            shard = Shard.load(folder, file)
            p = Pairs(shard, told, plan)
            totals = np.concatenate([np.zeros(0, np.int64), *(unpacked(x).astype(np.int64) for x, _ in own)])
            got = np.concatenate([np.zeros((0, SUMS)), *(unpacked(x).reshape(-1, SUMS) for _, x in own)])
            sums = np.zeros((len(shard.words) + 1, SUMS))
            sums[p.context] = got
            for i in np.flatnonzero(plan.hot(p.context_totals) | (np.arange(len(sums)) == len(shard.words))).tolist():
                sums[i] = hot.get(int(p.ids[i]), 0.0)
            back, scale = weights(sums, p.context_totals, d)
            c = p.totals[p.tokens]
            prob = unigrams.p(c)
            prob = np.where(p.context_totals[p.before] > 0, back[p.before] * prob, prob)
            pair = totals[p.at]
            first = p.before[p.usable]
            seen = np.where(pair > MOST, 1.0, d[np.minimum(pair, MOST)]) * pair / np.maximum(p.context_totals[first], 1) * scale[first]
            prob[p.usable] = np.where(pair > 0, seen, prob[p.usable])
            start = np.cumsum(shard.sizes.astype(np.int64)) - shard.sizes
            per = lambda x: np.add.reduceat(x, start)
            yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(shard.held > 0), pa.array(shard.sizes.astype(np.int64)), pa.array(per((c > 0).astype(np.int64))),
                                              pa.array(np.full(len(start), n, np.int64)), pa.array(per(np.log10((c + 1) / (n + v + 1)))), pa.array(per(np.log10(prob)))], names)

    rows = with_answers(shards, words, pairs)
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_digest(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    return scored(docs.select("doc_id", "text"), text_crc(docs["doc_id"]) % 7 == 2)
