"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its distinct words, pairs of neighbours and pairs with one word between,
lower-case (A-Z), hashed to 2**20 coordinates; punctuation and white space separate words. Per-coordinate
rates and L1 sparsity leave a few thousand weights, which every task gets.

The model learns from at most ``max_rows`` different (doc_id, text) pairs with a label, those of least hash, and of at most
``max_bytes`` of text, in hash order (texts of over an eighth of that are passed over). Repeated rows count once, however many there are. A document labelled more than once
is toxic if any label says so. Null labels are left out;
with no labelled row every score is 0. Null and empty texts get the score of the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import least_placed, mapped, text_crc, unpacked, written
from .textgrid import byte_array, kept, letter_table, lower_ascii, mixed, slice_hashes, sliced, word_bounds

BITS = 20


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of the update; ``epochs`` passes over the sample."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 4
    max_rows: int = 24_000
    max_bytes: int = 192 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every word, pair and skip pair, repeats included."""
    data = lower_ascii(data)
    starts, ends, bounds = word_bounds(data, offsets, kept("letters", letter_table)[data])
    h = slice_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    texts, hashes = [text], [h]
    for gap in (1, 2):
        inside = text[gap:] == text[:-gap]
        texts.append(text[gap:][inside])
        hashes.append(mixed(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] ^ np.uint64(gap)))[inside])
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def fit_sparse(rows: list[np.ndarray], labels: np.ndarray, with_: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that L1 leaves, and the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, with_.l1)
        held = np.maximum(np.abs(z[at]) - l1, 0.0)
        return -np.sign(z[at]) * held / ((with_.beta + np.sqrt(n[at])) / with_.alpha + with_.l2)

    for _ in range(with_.epochs):
        for own, label in zip(rows, labels):
            at = np.append(own, size)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / with_.alpha * w
            n[at] += g * g
    all_w = weights(np.arange(size + 1))
    left = np.flatnonzero(all_w[:size])
    return left, all_w[left], float(all_w[size])


def train(docs: DataFrame, labels: DataFrame, with_: Ftrl = Ftrl(), label: str = "toxic", keep: Column | None = None
          ) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The weights, from documents with a label (of those rows of ``labels`` where ``keep`` holds)."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    marked = (marked if keep is None else marked.where(keep)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    pairs = docs.select("doc_id", text_hash.alias("text_hash"), size.alias("size")).where(F.col("size") <= with_.max_bytes // 8).distinct()
    pairs = written(pairs.join(marked, "doc_id").withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(9))), "labelled-texts")
    # at most max_rows rows, so one task may order them and all tasks get them
    upto = F.sum("size").over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = least_placed(pairs, "place", with_.max_rows, ["doc_id"]).withColumn("upto", upto).where(F.col("upto") <= with_.max_bytes)
    chosen = written(chosen.select("doc_id", "text_hash", "place", "y"), "toxicity-sample")
    texts = docs.select("doc_id", "text", text_hash.alias("text_hash"))
    sample = texts.join(F.broadcast(chosen), ["doc_id", "text_hash"]).select("place", "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text, at = features(*byte_array(b.column("text")))
            both = np.unique((text << BITS) | at)
            own = np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, b.num_rows)))
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("y"), pa.array([x.tobytes() for x in own], pa.binary())], ["place", "y", "at"])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("place", "ascending"), ("at", "ascending")]).to_numpy()
        at = table["at"]
        rows = [np.frombuffer(at[i].as_buffer(), np.int32) for i in order.tolist()]  # views: the sample is held once
        left, w, bias = fit_sparse(rows, table["y"].to_numpy()[order], with_)
        return pa.table({"left": [left.astype(np.int32).tobytes()], "w": [w.tobytes()], "bias": [bias]})

    # repeated rows give equal ones, of which a task sends one
    rows = sample.mapInArrow(extract, "place long, y int, at binary").groupBy("place", "y").agg(F.min("at").alias("at")).withColumn("one", F.lit(1))
    model = rows.groupBy("one").applyInArrow(fit, "left binary, w binary, bias double").first()
    return model and (np.frombuffer(model["left"], np.int32), np.frombuffer(model["w"], np.float64), model["bias"])


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """``row`` (all columns) and ``toxic_score`` from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        if sent.value is not None:
            weights[sent.value[0]] = sent.value[1]
        for b in batches:
            table = pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), "text")], ["row", "text"])
            for part in sliced([table]):
                score = np.zeros(part.num_rows)
                if sent.value is not None:
                    text, at = features(*byte_array(part.column("text")))
                    used = weights[at] != 0
                    both = np.unique((text[used] << BITS) | at[used])
                    total = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], part.num_rows) + sent.value[2]
                    score = 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score)], ["row", "toxic_score"])

    return mapped(docs, work, "toxic_score double")


def learnable(name: str = "doc_id") -> Column:
    """The rows that may be learned from: crc32(doc_id) mod 5 is not 0."""
    return text_crc(F.col(name)) % 5 != 0


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    out = scored(docs, train(docs, labels, keep=learnable()))
    return out.select(F.col("row.doc_id").alias("doc_id"), (~learnable("row.doc_id")).alias("held_out"),
                      F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5, with their columns."""
    out = scored(docs, train(docs, labels, keep=learnable()))
    return out.where(F.col("toxic_score") < 0.5).select(*unpacked(docs).values())
