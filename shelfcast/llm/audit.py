"""What filters do to each other: every order of five filters, measured on all documents.

Filters A and B come from the document-term matrix (row sums and nonzero counts, see ``matrix``); upper-case letters, signs and a
text's SHA-256 are taken while documents are cut into shards. A document's failures are one bit each. Documents are added up per
part and set of failures, and all orders are played through on these at most 32 rows a part.

Null texts count as empty, a null part as the empty string. Of equal texts all but those with the smallest doc_id fail E; null
doc_ids come after all others. A document labelled more than once has a label if one row says so. Repeated rows count each. No document gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import row_statistics, term_matrix
from .tables import join_by_group, written
from .textgrid import byte_array

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]


@dataclass(frozen=True)
class Limits:
    """Fixed values of the contract, as defaults: A under ``least_words``; B and C in percent; D any of ``signs``."""

    least_words: int = 200
    least_distinct: int = 50
    most_upper: int = 3
    signs: bytes = b"#$%&*|"


def of_text(limits: Limits) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """doc_id, part, bits of C and D, and the text's hash."""
    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = byte_array(b.column("text"))
        sign = np.zeros(256, bool)
        sign[list(limits.signs)] = True

        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return np.diff(total[offsets])

        upper, points = per_text((data >= 65) & (data <= 90)), per_text((data & 0xC0) != 0x80)
        bits = (100 * upper > limits.most_upper * points) * 4 + (per_text(sign[data]) > 0) * 8
        whole = memoryview(np.ascontiguousarray(data))
        cuts = offsets.tolist()
        hashes = [hashlib.sha256(whole[a:z]).digest() for a, z in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part").fill_null(""), pa.array(bits.astype(np.int32)), pa.array(hashes, pa.binary())],
                                          ["doc_id", "part", "bits", "text_hash"])

    return kept


def failures(docs: DataFrame, part: Column, limits: Limits = Limits()) -> DataFrame:
    """Per document: doc_id, part, n_words, n_distinct, ``bits`` (1 for A, 2 for B, ... of the filters that it fails)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), part.cast("string").alias("part"))
    matrix, _, folder = term_matrix(chosen, of_text(limits))
    rows = row_statistics(matrix, folder, f"doc_id {kind}, part string, bits int, text_hash binary")
    short, same = F.col("n_words") < limits.least_words, 100 * F.col("n_distinct") < limits.least_distinct * F.col("n_words")
    rows = written(rows.withColumn("bits", F.col("bits") + short.cast("int") + 2 * same.cast("int")), "filter-bits")
    firsts = rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = join_by_group(rows, firsts, "text_hash", "copies", rows.count())
    later = F.col("first_id").isNotNull() & F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(True))
    return found.select("doc_id", "part", "n_words", "n_distinct", (F.col("bits") + 16 * later.cast("int")).alias("bits"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents added up per part and bits: n, n_good, n_toxic. Rows of one doc_id are added up before they meet its labels."""
    own = failed.groupBy("doc_id", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return (own.join(said, "doc_id", "left").groupBy("part", "bits")
            .agg(F.sum("n").alias("n"), marked("good").alias("n_good"), marked("toxic").alias("n_toxic")))


def played(cells: DataFrame) -> DataFrame:
    """All orders and steps per part, from its documents' failures."""
    order, step = F.col("filter_order"), F.col("step")
    fails = [F.col("bits").bitwiseAND(1 << k) != 0 for k in range(len(LETTERS))]
    # the step that removes a document: its first failing letter in this order
    gone = F.least(*[F.when(f, F.instr(order, letter)).otherwise(len(LETTERS) + 1) for f, letter in zip(fails, LETTERS)])
    at = (cells.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn("gone", gone)
          .withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(LETTERS))])))
          .withColumn("letter", F.substring(order, step, F.lit(1)))
          .withColumn("own", F.pow(F.lit(2), F.instr(F.lit(LETTERS), F.col("letter")) - 1).cast("int")))
    failing = F.col("bits").bitwiseAND(F.col("own")) != 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))

    here = F.col("gone") == step
    out = at.groupBy("part", "filter_order", "step", "letter").agg(
        total(F.col("gone") > step).alias("kept"), total(here).alias("removed"), total(failing & (F.col("gone") < step)).alias("redundant"),
        total(F.col("bits") == F.col("own")).alias("unique_fails"), total(here, "n_good").alias("good_lost"), total(here, "n_toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    return played(written(with_labels(failures(docs, docs[part], limits), labels), "filter-cells"))
