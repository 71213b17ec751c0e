"""Exact duplicates by sorting content.

Rows are range-partitioned by sampled splitters over (first bytes of the normalised text, its hash,
doc_id) and sorted externally, so that equal texts are neighbours; a sweep compares each text in full
with the one before. doc_id among the splitters lets a group of any size spread over partitions. Only
the runs at a partition's ends can go on elsewhere: these summaries, two per partition, are joined by
their SHA-256 and sent to all tasks.

Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty, and all
empty texts are one group. The row with the most code points in its original text stays, then the
smallest doc_id (null last), then any one of several identical rows. No row gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import unpacked, written

SPACES = r"[\x20\x09-\x0D]+"  # fixed by the contract
FLUSH_ROWS, FLUSH_BYTES = 4096, 8 << 20


def content_sorted(docs: DataFrame, with_rows: bool) -> DataFrame:
    """Rows in content order: prefix, h, norm, n_points, doc_id and, if asked for, all columns in ``row``."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if with_rows else []
    out = docs.select(docs["doc_id"].alias("doc_id"), F.length(text).alias("n_points"), F.regexp_replace(text, SPACES, "").alias("norm"), *rows)
    out = out.withColumn("prefix", F.substring("norm", 1, 16)).withColumn("h", F.xxhash64("norm"))
    order = ["prefix", "h", "norm", F.col("n_points").desc(), F.col("doc_id").asc_nulls_last()]
    return out.repartitionByRange("prefix", "h", "doc_id").sortWithinPartitions(*order)


def runs(docs: DataFrame, with_rows: bool = False) -> DataFrame:
    """Per row: its run's leader and size within the partition, ``first`` (it is that leader), and ``edge``:
    the run may go on in another partition. ``row`` is kept for leaders only."""
    ordered = content_sorted(docs, with_rows)
    id_kind, row_kind = ordered.schema["doc_id"].dataType.simpleString(), None
    if with_rows:
        row_kind = ordered.schema["row"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "sha256", "keep_id", "keep_points", "run_size", "first", "edge", *(["row"] if with_rows else [])]
        out: list[list] = [[] for _ in names]
        group: list[dict] = []  # the runs that share prefix and hash
        key, opening, held, kinds, text, last = None, True, 0, None, None, None

        def close(edge: bool) -> None:
            nonlocal held
            for run in group:
                sha, n = hashlib.sha256(run["norm"].encode()).hexdigest(), len(run["ids"])
                held += run["bytes"]
                values = [run["ids"], [sha] * n, run["ids"][:1] * n, [run["points"]] * n, [n] * n, [True] + [False] * (n - 1), [edge] * n]
                for to, x in zip(out, [*values, *([[run["row"]] + [None] * (n - 1)] if with_rows else [])]):
                    to.extend(x)
            group.clear()

        def batch() -> pa.RecordBatch:
            nonlocal held
            held = 0
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)
            for x in out:
                x.clear()
            return made

        for b in batches:
            if b.num_rows == 0:
                continue
            norm = b.column("norm")
            kinds = [b.column("doc_id").type, pa.string(), b.column("doc_id").type, pa.int32(), pa.int64(), pa.bool_(), pa.bool_(),
                     *([b.column("row").type] if with_rows else [])]
            same = [last is not None and norm[0].as_py() == last, *pc.equal(norm[1:], norm[:-1]).to_pylist()]
            keys = list(zip(b.column("prefix").to_pylist(), b.column("h").to_pylist()))
            points = b.column("n_points").to_pylist()
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                if same[i]:
                    group[-1]["ids"].append(doc_id)
                    continue
                if keys[i] != key:
                    if group:
                        close(opening)
                        opening = False
                    key = keys[i]
                    if len(out[0]) >= FLUSH_ROWS or held >= FLUSH_BYTES:
                        yield batch()
                text = norm[i].as_py()
                group.append({"norm": text, "ids": [doc_id], "points": points[i], "bytes": len(text) * with_rows,
                              "row": b.column("row")[i].as_py() if with_rows else None})
            last = norm[b.num_rows - 1].as_py()
        if group:
            close(True)
        if out[0]:
            yield batch()

    return ordered.mapInArrow(sweep, f"doc_id {id_kind}, sha256 string, keep_id {id_kind}, keep_points int, run_size long, first boolean, edge boolean"
                              + (f", row {row_kind}" if with_rows else ""))


def stitched(found: DataFrame) -> DataFrame:
    """``found`` with the leader and size over all partitions: ``best_id``, ``best_points``, ``group_size``."""
    ends = found.where("first and edge").withColumn("place", F.struct(-F.col("keep_points"), F.col("keep_id").isNull(), F.col("keep_id").alias("id")))
    ends = ends.groupBy(F.col("sha256").alias("end_sha")).agg(F.min("place").alias("best"), F.sum("run_size").alias("size_all"))
    joined = found.join(F.broadcast(ends), F.col("edge") & (F.col("sha256") == F.col("end_sha")), "left")
    here = F.col("end_sha").isNotNull()
    return joined.select(*found.columns, F.when(here, F.col("best.id")).otherwise(F.col("keep_id")).alias("best_id"),
                         F.coalesce("size_all", "run_size").alias("group_size"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256. Rows that repeat the leader's doc_id in full are ``kept`` too."""
    out = stitched(written(runs(docs.select("doc_id", "text")), "content-runs"))
    return out.select("doc_id", F.col("best_id").alias("keep_id"), "group_size",
                      F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns."""
    found = written(runs(docs, with_rows=True).where("first"), "content-leaders")
    inner = found.where("not edge")
    order = [F.col("keep_points").desc(), F.col("keep_id").asc_nulls_last()]
    # leaders of runs that go on: two per partition, so the rows of a text are few
    ends = found.where("edge").withColumn("n", F.row_number().over(Window.partitionBy("sha256").orderBy(*order))).where("n = 1").drop("n")
    return inner.unionByName(ends).select(*unpacked(docs).values())
