"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are range-sorted by length and keep their place among those of equal length; sequences with room
left (gaps) are range-sorted by that room in every round. A round sweeps over lengths from long to short:
each length's documents go to the smallest gaps that hold them (a gap takes as many of one length as
fit), and since equal documents contend for equal gaps, the k-th of them gets the k-th gap: a conflict is
settled by rank. Then the gaps shrink and the next round begins. A round takes lengths down to half of
the longest left (once that is 8 or less, all that are left), so shorter ones see the gaps that longer ones leave. What
fits nowhere opens sequences: one for each document over half a sequence, else as many as the left tokens fill.

Only the numbers of documents and of gaps per length (1024 at most each) and the matched ranges of ranks
are known to the driver; documents and gaps meet in Spark, joined by room and rank.

Null and empty texts have the end token alone. Longer documents than a sequence are cut into full pieces with
the rest, if any, as the first. No row gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written
from .textgrid import byte_array, sliced
from .vocab import byte_bpe, with_end

CAPACITY, END = 1024, 2  # fixed by the contract


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = byte_bpe(path)
        for b in sliced(batches):
            ids, bounds = with_end(*vocabulary.encode(*byte_array(b.column("text"))), end)
            ids, size = ids.astype("<u4"), np.diff(bounds)
            count = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            rest = (size - (count - 1) * capacity)[owner]  # the first piece
            start = np.where(number == 0, 0, rest + (number - 1) * capacity)
            length = np.where(number == 0, rest, capacity)
            at = (bounds[:-1][owner] + start).tolist()
            crc = [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(at, length.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def placed_by(rows: DataFrame, size: str, tie: str, name: str) -> DataFrame:
    """``rows`` range-sorted by ``size`` and written, with ``place``: the rank among rows of equal size, from 0.

    Equal sizes may spread over partitions; the counts of earlier partitions (one row per size and
    partition that holds it) are added to the place within a partition.
    """
    at = F.monotonically_increasing_id()
    rows = written(rows.repartitionByRange(size, tie).sortWithinPartitions(size, tie).withColumn("at", at).withColumn("part", F.shiftright("at", 33)), name)
    before = Window.partitionBy(size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(size, "part").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(F.broadcast(counts), [size, "part"]).withColumn("place", F.col("at") - F.col("first_at") + F.col("earlier")).drop("at", "part", "first_at", "earlier")


def sweep(docs: np.ndarray, gaps: np.ndarray, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of a round, (length, documents taken, n, gap, first gap, documents per gap), from the longest length to ``least``.

    docs[s] and gaps[g] count what is left of each length and room; each gap is used by one length at most.
    """
    taken, out = np.zeros_like(gaps), []
    for s in range(len(docs) - 1, least - 1, -1):
        done, g = 0, s
        while done < docs[s]:
            free = np.flatnonzero(gaps[g:] > taken[g:])
            if not len(free):
                break
            g += int(free[0])
            each = g // s
            n = int(min(docs[s] - done, (gaps[g] - taken[g]) * each))
            out.append((s, done, n, g, int(taken[g]), each))
            taken[g] += -(-n // each)
            done += n
    return out


def settle(docs: np.ndarray, gaps: np.ndarray, matches: list[tuple[int, int, int, int, int, int]]) -> None:
    """The counts after a round."""
    for s, _, n, g, _, each in matches:
        full, rest = divmod(n, each)
        docs[s] -= n
        gaps[g] -= full + (rest > 0)
        gaps[g - each * s] += full
        if rest:
            gaps[g - rest * s] += 1


def to_open(docs: np.ndarray, least: int, capacity: int) -> int:
    """How many sequences the documents from ``least`` on need at least."""
    large = int(docs[capacity // 2 + 1:].sum())
    return large or int(-(-(docs[least:] * np.arange(least, len(docs))).sum() // capacity))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``capacity``."""
    spark, columns = pieces.sparkSession, pieces.columns
    pieces = written(pieces.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("piece_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    docs = placed_by(pieces.where(F.col("length") < capacity), "length", "piece_key", "pieces-by-length")
    left, gaps = np.zeros(capacity, np.int64), np.zeros(capacity + 1, np.int64)
    for r in docs.groupBy("length").count().collect():  # fewer than capacity rows
        left[r["length"]] = r["count"]
    total, opened, out = left.copy(), 0, [full]
    rooms: DataFrame | None = None
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        least = longest // 2 + 1 if longest > 8 else 1
        matches = sweep(left, gaps, least)
        if not matches:
            n = to_open(left, least, capacity)
            fresh = empty_sequences(spark, opened, n, capacity, int(gaps[capacity]))
            rooms = fresh if rooms is None else rooms.unionByName(fresh)
            gaps[capacity] += n
            opened += n
            continue
        first = total - left
        plan = spark.createDataFrame([(s, int(first[s]) + done, n, g, at, each) for s, done, n, g, at, each in matches],
                                     "of long, from_doc long, n long, room long, from_gap long, each long")
        out.append(written(matched(docs.where(F.col("length").between(least, longest)), rooms, plan, columns, capacity), "packed"))
        settle(left, gaps, matches)
        useful = int(np.flatnonzero(left)[0]) if left.any() else capacity
        gaps[:useful] = 0
        rooms = placed_by(shrunk(rooms, plan).where(F.col("gap") >= useful), "gap", "sequence_id", "gaps")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def empty_sequences(spark: SparkSession, first_id: int, n: int, capacity: int, place: int) -> DataFrame:
    return spark.range(n).select((F.col("id") + first_id).alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"), (F.col("id") + place).alias("place"))


def matched(docs: DataFrame, rooms: DataFrame, plan: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """The documents of a round's matches with their sequences."""
    plan = F.broadcast(plan)  # a few thousand ranges at most
    rank = F.col("place") - F.col("from_doc")
    own = docs.join(plan, (docs["length"] == plan["of"]) & (F.col("place") >= F.col("from_doc")) & (F.col("place") < F.col("from_doc") + F.col("n")))
    own = own.select(*columns, "room", F.expr("from_gap + (place - from_doc) div each").alias("gap_place"), (rank % F.col("each")).alias("slot"))
    spots = rooms.select(F.col("gap").alias("room"), F.col("place").alias("gap_place"), "sequence_id")
    return own.join(spots, ["room", "gap_place"]).select(*columns, "sequence_id", (capacity - F.col("room") + F.col("slot") * F.col("length")).alias("offset"))


def shrunk(rooms: DataFrame, plan: DataFrame) -> DataFrame:
    """All sequences with the room that the matches leave."""
    plan = F.broadcast(plan)
    at = F.col("place") - F.col("from_gap")
    hit = rooms.join(plan, (rooms["gap"] == plan["room"]) & (at >= 0) & (at * F.col("each") < F.col("n")), "left")
    held = F.least(F.col("each"), F.col("n") - at * F.col("each"))
    return hit.select("sequence_id", (F.col("gap") - F.coalesce(held * F.col("of"), F.lit(0))).alias("gap"))


def packing_digest(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(docs))
