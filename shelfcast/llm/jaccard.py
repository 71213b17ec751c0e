"""Similarity join of documents on word shingles by chosen paths.

A document's set holds its windows of five words (all its words as one window if it has fewer); words are
runs outside [\\x20\\x09-\\x0D]. Documents with equal sets are copies and go on as one. Every set has a
signature of 64 minima, whose coordinates stand for shared tokens. From each of a number of roots, every
node of the tree samples two coordinates; a set goes to one child per coordinate, named by the path, the
coordinate and the set's value there. A node with at most ``small`` sets is compared by brute force; a larger one
splits on, unless it holds most of its parent's sets already (near copies, which no split parts) or is
``depth`` deep. Two sets of similarity 0.8 share a
child of a node with probability 0.96, and a leaf below a root with more than 0.94; roots are added until the
recall expected over the minima in which such a pair agrees reaches ``recall``.

Compared are signatures, with a slack of five deviations at least; sets that pass form candidate groups, in which
every pair is checked exactly on full sets. Links of similarity ``least`` or more form classes.
No pair is ever written: tasks return numbers of links and the least member reached.

A leaf or group of several blocks moves each set once: its blocks become files of the shared folder, and the tasks that compare
two blocks are sent their names only. Numbers of links in a large group still take a comparison of all its pairs, spread over
all tasks.

Null and empty texts have the empty set: they are copies of each other and link to nothing else. Rows without
doc_id take part; a class that has no doc_id at all has no class_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import opened, save
from .tables import join_by_group, new_folder, unpacked, written
from .textgrid import byte_array, mixed, slice_hashes, sliced, window_hashes, within, word_bounds

MINIMA, WORDS = 64, 5
RUN = 32  # pairs of blocks that a task compares with one first block


@dataclass(frozen=True)
class Join:
    """``least``: similarity of a link; ``recall``: expected share of links found."""

    least: float = 0.8
    recall: float = 0.99999
    small: int = 200
    depth: int = 6
    same: float = 0.6
    block: int = 1024
    exact_block: int = 128

    def agreeing(self) -> np.ndarray:
        """Chance that a pair of similarity ``least`` agrees in 0, 1, ... MINIMA minima."""
        return np.array([math.comb(MINIMA, k) * self.least**k * (1 - self.least) ** (MINIMA - k) for k in range(MINIMA + 1)])

    def need(self) -> float:
        """Minima in which compared signatures must agree: five deviations of slack, more where these lose half of what ``recall`` allows."""
        slack = 5 * math.sqrt(self.least * (1 - self.least) / MINIMA)
        lost = np.cumsum(self.agreeing())  # at k: chance of k minima or fewer
        return min((self.least - slack) * MINIMA, int((lost <= (1 - self.recall) / 2).sum()))

    def expected(self, roots: int) -> float:
        """Recall of a lone pair of similarity ``least``, over the minima it agrees in: all roots sample the same ones.

        With two children a node, a pair that shares a child with probability s survives p = 1 - (1 - s p)**2 per level.
        """
        share, p = np.arange(MINIMA + 1) / MINIMA, np.ones(MINIMA + 1)
        for _ in range(self.depth):
            p = 1 - (1 - share * p) ** 2
        found = np.where(np.arange(MINIMA + 1) >= self.need(), 1 - (1 - p) ** roots, 0.0)
        return float((self.agreeing() * found).sum())

    def roots(self) -> int:
        n = 1
        while self.expected(n) < self.recall:
            n += 1
        return n


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of all texts, text after text, each text's in order; the n + 1 bounds."""
    n = len(offsets) - 1
    starts, ends, bounds = word_bounds(data, offsets)
    words = slice_hashes(data, starts, ends)
    at, text = within(bounds, WORDS)
    h = window_hashes(words, WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WORDS)).tolist():
        own = words[bounds[i]:bounds[i + 1]]
        h, text = np.append(h, window_hashes(own ^ np.uint64(len(own)), len(own))), np.append(text, i)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(n + 1))


def per_set(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc, empty: int) -> np.ndarray:
    """ufunc over each set's values."""
    out = np.full(len(bounds) - 1, empty, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that name a set."""
    a = per_set(mixed(h ^ np.uint64(0x51ED2701)), bounds, np.add, 0)
    b = per_set(mixed(h ^ np.uint64(0xA2F36F5B)), bounds, np.add, 0)
    return np.column_stack([a, b])


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(77)
    out = np.zeros((len(bounds) - 1, MINIMA), np.uint32)
    for i, (a, b) in enumerate(zip(rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, MINIMA, np.uint64))):
        out[:, i] = per_set((h * a + b) >> np.uint64(32), bounds, np.minimum, 0)
    return out


def document_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row_key (a hash of id and text), set_key, n (shingles), sig."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            h, bounds = shingle_sets(*byte_array(b.column("text")))
            keys, sig = set_keys(h, bounds).tobytes().hex(), signatures(h, bounds)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("row_key"), pa.array([keys[i * 32:i * 32 + 32] for i in range(b.num_rows)]), pa.array(np.diff(bounds), pa.int64()),
                pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "row_key", "set_key", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key(docs), "text").mapInArrow(work, f"doc_id {kind}, row_key long, set_key string, n long, sig binary")


def row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key")


def children(nodes: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Two children of each (node, signature): n x 2 node names."""
    pick = mixed(nodes)
    first = (pick >> np.uint64(40)) % np.uint64(MINIMA)
    second = (first + np.uint64(1) + (pick & np.uint64(0xFFFFFF)) % np.uint64(MINIMA - 1)) % np.uint64(MINIMA)
    row = np.arange(len(nodes))
    out = [mixed(nodes * np.uint64(0x9E3779B97F4A7C15) ^ mixed(sig[row, c.astype(np.int64)].astype(np.uint64) | (c + np.uint64(1)) << np.uint64(40))) for c in (first, second)]
    return np.column_stack(out)


def split(rows: DataFrame) -> DataFrame:
    """(rep, node, held) of the children of (rep, sig, node, held); held: how many sets the parent holds."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, MINIMA)
                nodes = children(b.column("node").to_numpy().view(np.uint64), sig)
                twice = pa.array(np.repeat(np.arange(b.num_rows), 2))
                yield pa.RecordBatch.from_arrays([b.column("rep").take(twice), pa.array(nodes.ravel().view(np.int64)), b.column("held").take(twice)], ["rep", "node", "held"])

    return rows.select("rep", "sig", "node", "held").mapInArrow(work, "rep long, node long, held long")


def leaves(reps: DataFrame, n_reps: int, with_: Join) -> list[DataFrame]:
    """(rep, node, size) of nodes that are compared by brute force, a frame per level."""
    roots = F.explode(F.array(*[F.xxhash64(F.lit(r)) for r in range(with_.roots())])).alias("node")
    level, out = split(reps.select("rep", "sig", roots, F.lit(n_reps).cast("long").alias("held"))), []
    for depth in range(1, with_.depth + 1):
        level = written(level, "nodes")
        sizes = written(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "node-sizes")
        rows = join_by_group(level, sizes, "node", "size", level.count()).where("size > 1")
        done = (F.col("size") <= with_.small) | (F.col("size") >= with_.same * F.col("held")) | F.lit(depth == with_.depth)
        rows = written(rows.withColumn("done", done), "sized-nodes")
        out.append(rows.where("done").select("rep", "node", "size"))
        more = rows.where("not done")
        if more.isEmpty():
            break
        level = split(more.select("rep", "node", F.col("size").alias("held")).join(reps.select("rep", "sig"), "rep"))
    return out


def by_block(rows: DataFrame, group: str, payload: str) -> DataFrame:
    """Rows in the order of their group's blocks: cell (names the block), grp, own (its number), blocks, rep and ``payload``."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("own")
    dealt = rows.select(F.col(group).alias("grp"), own, "blocks", "rep", payload)
    return dealt.select(F.xxhash64("grp", "own").alias("cell"), "*").repartition("cell").sortWithinPartitions("cell")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches in order of ``cell``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        cell = b.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column("cell")[0].as_py() != cell[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


STORED = "grp long, own long, blocks long, file string"


def stored(t: pa.Table, folder: str) -> list:
    """The values of STORED for a block whose rep and payload now lie in a file."""
    sink = pa.BufferOutputStream()
    kept = t.select([t.column_names[-2], t.column_names[-1]])
    with pa.ipc.new_stream(sink, kept.schema) as to:
        to.write_table(kept)
    return [t["grp"][0].as_py(), t["own"][0].as_py(), t["blocks"][0].as_py(), save(folder, ".block", [sink.getvalue().to_pybytes()])]


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(file, second) of all pairs of blocks of a group, a block with itself included; runs of them share their first."""
    spark, n = blocks.sparkSession, blocks.agg(F.sum(F.col("blocks") - F.col("own"))).first()[0]
    pairs = (blocks.withColumn("other", F.explode(F.sequence("own", F.col("blocks") - 1)))
             .join(blocks.select("grp", F.col("own").alias("other"), F.col("file").alias("second")), ["grp", "other"]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RUN)
    return pairs.repartition(parts, "grp", "own", F.floor(F.col("other") / RUN)).sortWithinPartitions("grp", "own", "other").select("file", "second")


def paired_blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each pair of blocks and their side: 0 or 1, or 2 if both blocks are one."""
    fs, path = opened(folder)

    def load(file: str) -> pa.Table:
        with fs.open_input_stream(f"{path}/{file}") as stream:
            return pa.ipc.open_stream(stream.read()).read_all()

    name, first = None, None
    for b in batches:
        for file, other in zip(b.column("file").to_pylist(), b.column("second").to_pylist()):
            if file != name:
                name, first = file, load(file)
            second = None if other == file else load(other)
            yield (first, np.full(first.num_rows, 2)) if second is None else (pa.concat_tables([first, second]), np.repeat([0, 1], [first.num_rows, second.num_rows]))


def allowed(side: np.ndarray) -> np.ndarray:
    """Which pairs are compared: across two blocks, or all of one block."""
    return np.triu((side[:, None] == 2) | (side[:, None] != side[None, :]), 1)


def least_reached(rep: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Per row the least rep it is connected with by ``linked`` (upper triangle)."""
    low = rep.copy()
    i, j = np.nonzero(linked)
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        if (low == before).all():
            break
    return low


def alike(t: pa.Table, side: np.ndarray, need: float) -> pa.RecordBatch:
    """(a, b): rows whose signatures are alike, joined to the least one they reach."""
    rep, sig = t["rep"].to_numpy(), np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, MINIMA)
    agree, minima = np.zeros((len(rep), len(rep)), np.uint8), np.ascontiguousarray(sig.T)
    for lo in range(0, len(rep), 64):  # a strip of the upper triangle, small enough for the cache
        strip = agree[lo:lo + 64, lo:]
        for own in minima:
            strip += own[lo:lo + 64, None] == own[None, lo:]
    near = np.triu(agree >= need, 1)
    low = least_reached(rep, near)
    use = low != rep
    if len(side) and side[0] != 2:
        # either block alone joins its members elsewhere; here one member speaks for what they join
        use &= least_reached(rep, near & (side[:, None] == side[None, :])) == rep
    return pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(low[use])], ["a", "b"])


def candidates(found: DataFrame, reps: DataFrame, with_: Join) -> DataFrame:
    """(a, b): sets whose signatures are alike, joined to the least one they reach within a leaf or two of its blocks. A row per set and leaf, and few more."""
    need, folder = with_.need(), new_folder(found.sparkSession, "signature-blocks")
    names = ["a", "b", "grp", "own", "blocks", "file"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, files, n = [], [], 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x.column(i).to_numpy() for x in links)]) for i in (0, 1))
            none = [None] * len(a)
            cols = [pa.array([*none, *(f[i] for f in files)], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            no_link = pa.nulls(len(files), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), no_link]), pa.concat_arrays([pa.array(b), no_link]), *cols], names)

        for t in by_cell(batches):
            if t["blocks"][0].as_py() > 1:
                files.append(stored(t, folder))
            elif t.num_rows > 1:
                links.append(alike(t, np.full(t.num_rows, 2), need))
                n += links[-1].num_rows
            if n + len(files) > 20_000:
                yield flush()
                links, files, n = [], [], 0
        if links or files:
            yield flush()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, side in paired_blocks(batches, folder):
            yield alike(t, side, need)

    rows = found.withColumn("blocks", F.ceil(F.col("size") / with_.block)).join(reps.select("rep", "sig"), "rep")
    told = written(by_block(rows, "node", "sig").mapInArrow(local, "a long, b long, " + STORED), "alike-sets")
    links, blocks = told.where("file is null").select("a", "b"), told.where("file is not null").select("grp", "own", "blocks", "file")
    return links if blocks.isEmpty() else links.unionByName(block_pairs(blocks).mapInArrow(across, "a long, b long"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence columns (those that two sets share)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    code = pd.factorize(np.concatenate(sets))[0]
    shared = np.bincount(code)[code] > 1
    owner, code = owner[shared], pd.factorize(code[shared])[0]
    out, order = np.zeros((len(sets), len(sets)), np.float32), np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        own = slice(*np.searchsorted(code, [lo, lo + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[own], code[own] - lo] = 1
        out += m @ m.T
    return out


def linked_sets(t: pa.Table, side: np.ndarray, least: float) -> pa.RecordBatch:
    """(rep, links, low): numbers of exact links and the least set reached by them."""
    rep, first = np.unique(t["rep"].to_numpy(), return_index=True)  # rows given twice count once
    shingles = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["shingles"].take(pa.array(first))]
    size, both = np.array([len(s) for s in shingles], np.float64), overlaps(shingles).astype(np.float64)
    linked = both * (1 + least) >= least * (size[:, None] + size[None, :]) - 1e-6
    linked &= allowed(side[first]) & (both > 0)
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.array((linked.sum(0) + linked.sum(1)).astype(np.int64)), pa.array(least_reached(rep, linked))], ["rep", "links", "low"])


def verified(docs: DataFrame, members: DataFrame, with_: Join) -> DataFrame:
    """(rep, links, low, blocks) per group or pair of blocks: numbers of exact links and the least set reached by them.

    ``members``: rep, row_key, set_key, grp, blocks of the sets in candidate groups.
    """
    texts = docs.select(row_key(docs), docs["text"].alias("text")).join(members, "row_key")
    folder, least = new_folder(docs.sparkSession, "shingle-blocks"), with_.least
    names = ["rep", "links", "low", "grp", "own", "blocks", "file"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            h, bounds = shingle_sets(*byte_array(b.column("text")))
            keys = set_keys(h, bounds).tobytes().hex()
            own = np.array([keys[i * 32:i * 32 + 32] == k for i, k in enumerate(b.column("set_key").to_pylist())])  # not if another row has the same row_key
            packed = pa.array([h[lo:hi].tobytes() for lo, hi in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary())
            made = pa.RecordBatch.from_arrays([b.column("rep"), b.column("grp"), b.column("blocks"), packed], ["rep", "grp", "blocks", "shingles"])
            yield made.filter(pa.array(own))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_cell(batches):
            if t["blocks"][0].as_py() > 1:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, *(pa.array([x]) for x in stored(t, folder))], names)
            else:
                found = linked_sets(t, np.full(t.num_rows, 2), least)
                none = pa.nulls(found.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*found.columns, none, none, pa.array(np.ones(found.num_rows, np.int64)), pa.nulls(found.num_rows, pa.string())], names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, side in paired_blocks(batches, folder):
            yield linked_sets(t, side, least)

    rows = texts.select("text", "rep", "set_key", "grp", "blocks").mapInArrow(sets, "rep long, grp long, blocks long, shingles binary")
    told = written(by_block(rows, "grp", "shingles").mapInArrow(local, "rep long, links long, low long, " + STORED), "verified")
    links, blocks = told.where("file is null").select("rep", "links", "low", "blocks"), told.where("file is not null").select("grp", "own", "blocks", "file")
    if blocks.isEmpty():
        return links
    wide = written(block_pairs(blocks).mapInArrow(across, "rep long, links long, low long"), "verified-blocks")
    return links.unionByName(wide.withColumn("blocks", F.lit(2).cast("long")))


def classes(docs: DataFrame, with_: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): per row its doc_id, row_key and set_key; per set its rep, number of links, copies and class."""
    rows = written(document_sets(docs), "document-sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    grouped = rows.groupBy("set_key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    reps = written(grouped.select(F.monotonically_increasing_id().alias("rep"), "set_key", F.col("first.id").alias("first_id"), F.col("first.key").alias("row_key"),
                                  "copies", "sig", "n"), "sets")
    found: DataFrame | None = None
    for x in leaves(reps.where("n > 0"), reps.count(), with_):
        found = x if found is None else found.unionByName(x)
    groups = components(candidates(found, reps, with_)).select(F.col("node").alias("rep"), F.col("label").alias("grp"))
    members = groups.join(reps.select("rep", "row_key", "set_key", "n"), "rep")
    sizes = written(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    members = join_by_group(members, sizes, "grp", "size", groups.count())
    # blocks of bounded bytes: by the number of sets, and by their shingles where those are many
    heavy = members.groupBy("grp").agg(F.sum("n").alias("shingles"))
    blocks = written(sizes.join(heavy, "grp").select("grp", "size", F.greatest(F.ceil(F.col("size") / with_.exact_block), F.ceil(F.col("shingles") / 1_000_000)).alias("blocks")), "group-blocks")
    members = join_by_group(members.drop("size"), blocks, "grp", "size", groups.count()).select("rep", "row_key", "set_key", "grp", "blocks")
    checked = verified(docs, written(members, "members"), with_)
    links = checked.groupBy("rep").agg(F.sum("links").alias("n_links"))
    spread = components(checked.where("blocks > 1 and low <> rep"), "rep", "low").select(F.col("node").alias("rep"), F.col("label").alias("wide"))
    local = checked.where("blocks = 1").select("rep", "low")
    sets = (reps.drop("sig").join(links, "rep", "left").join(local, "rep", "left").join(spread, "rep", "left")
            .select("rep", "set_key", "first_id", "row_key", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("wide", "low", "rep").alias("class")))
    return rows, written(sets, "set-classes")


def keepers(sets: DataFrame) -> DataFrame:
    """Per class the set with the smallest doc_id: class, class_id, row_key."""
    first = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("row_key").alias("key"))
    return sets.groupBy("class").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n_sets")).select("class", F.col("first.id").alias("class_id"), F.col("first.key").alias("row_key"), "n_sets")


def join_digest(docs: DataFrame, with_: Join = Join()) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id of its class), copy_of (the smallest with the same
    shingles), n_links (other sets of shingles with similarity 0.8 or more)."""
    rows, sets = classes(docs, with_)
    best = written(keepers(sets).select("class", "class_id", "n_sets"), "class-ids")
    sets = join_by_group(sets, best, "class", "n_sets", sets.count())
    told = written(sets.select("set_key", "copies", F.col("first_id").alias("copy_of"), "class_id", "n_links"), "told-sets")
    return join_by_group(rows.select("doc_id", "set_key"), told, "set_key", "copies", rows.count()).select("doc_id", "class_id", "copy_of", "n_links")


def distinct_by_similarity(docs: DataFrame, with_: Join = Join()) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with its columns."""
    rows, sets = classes(docs, with_)
    keep = written(keepers(sets).select("row_key"), "kept-rows")
    twice = written(rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(keep, "row_key").select("row_key", F.lit(True).alias("again")), "rows-given-twice")
    rows_of = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs))
    out = rows_of.join(keep.join(twice, "row_key", "left"), "row_key")
    once = out.where("again is null").unionByName(out.where("again").dropDuplicates(["row_key"]))
    return once.select(*unpacked(docs).values())
