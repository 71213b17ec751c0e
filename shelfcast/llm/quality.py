"""Quality rules and isolation forests over their statistics.

Every text's rule statistics are counted whole. A forest's random splits, drawn from at most
``pool_rows`` documents (least hash of doc_id; equal rows count once), give each document a mean path length; short paths mean
odd documents. One forest sees all ratios, one only those of signs and letters, which lengths of texts
don't move; a document is as odd as the higher of its two scores. All labelled rows calibrate the threshold: it rejects as many rows of quality 0 as it
can while at most ``spare`` of the rows of quality 1 go.

Null and empty texts have no words and fail the base rules. Without labels of either class, nothing is
rejected beyond the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import least_placed, written
from .textgrid import byte_array, kept, mixed, slice_hashes, sliced, space_table, window_hashes, within, word_bounds

SYMBOLS = b"#*$%&|<>"  # fixed by the contract
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_share", "upper_share", "mark_share", "same_next_share", "dup_line_share", "repeat_share", "again_share", "mean_length"]
SIGNS = 4  # the second forest sees the first four alone
STEPS = 2000  # grid of the calibrated threshold


@dataclass(frozen=True)
class Forest:
    trees: int = 128
    rows: int = 256
    pool_rows: int = 8192
    spare: float = 0.005
    seed: int = 5


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: it occurs more than once; it occurred before."""
    code = pd.factorize(keys)[0]
    counts = np.bincount(code, minlength=1) if len(code) else np.zeros(1, np.int64)
    first = np.zeros(len(code), bool)
    first[np.unique(code, return_index=True)[1]] = True
    return counts[code] > 1, ~first


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules and the ratios the forests see, per text."""
    n = len(offsets) - 1
    solid = ~kept("spaces", space_table)[data]
    starts, ends, bounds = word_bounds(data, offsets)
    n_words = np.diff(bounds)
    word_text = np.repeat(np.arange(n), n_words)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    marks = np.zeros(256, bool)
    marks[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    upper, letter = (data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122)
    out = {"n_words": n_words, "word_chars": per_text(solid & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(symbols[data], offsets)}
    # lines: cut at \n and at a text's edges
    cuts = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    ended = (line_ends > line_starts) & (data[line_ends - 1] == 10) if len(data) else np.zeros(0, bool)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    h = slice_hashes(data, line_starts, line_ends - ended)[has_word]
    line_text = line_text[has_word]
    dup = repeated(mixed(h ^ (line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))[1]
    out["n_dup_lines"] = np.bincount(line_text[dup], minlength=n)
    # words under a window of five that occurs again in its text
    words = slice_hashes(data, starts, ends)
    at, text = within(bounds, 5)
    salt = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = at[repeated(mixed(window_hashes(words, 5)[at] ^ salt))[0]] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    out["n_repeat_words"] = np.bincount(word_text[np.cumsum(cover)[:-1] > 0], minlength=n)
    again = repeated(mixed(words ^ (word_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))[1]
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (word_text[1:] == word_text[:-1])
    per = lambda x, y: x / np.maximum(y, 1)
    out |= {"symbol_share": per(out["n_symbols"], out["word_chars"]), "upper_share": per(per_text(upper, offsets), per_text(letter, offsets)),
            "mark_share": per(per_text(marks[data], offsets), out["word_chars"]),
            "same_next_share": per(np.bincount(word_text[same], minlength=n), n_words),
            "dup_line_share": per(out["n_dup_lines"], np.bincount(line_text, minlength=n)), "repeat_share": per(out["n_repeat_words"], n_words),
            "again_share": per(np.bincount(word_text[again], minlength=n), n_words), "mean_length": per(out["word_chars"], n_words)}
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the ratios of every document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = statistics(*byte_array(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(made[c], pa.int64()) for c in COUNTS),
                                              *(pa.array(made[c], pa.float64()) for c in RATIOS)], ["doc_id", *COUNTS, *RATIOS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS]))


def path_mean(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(pool: np.ndarray, with_: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees as complete binary arrays: split column (-1: leaf), split value, path length of leaves."""
    rng, depth = np.random.default_rng(with_.seed), int(np.ceil(np.log2(max(2, min(with_.rows, len(pool))))))
    size = 2 ** (depth + 1) - 1
    column, value, length = np.full((with_.trees, size), -1), np.zeros((with_.trees, size)), np.zeros((with_.trees, size))
    for t in range(with_.trees):
        todo = [(0, 0, pool[rng.choice(len(pool), min(with_.rows, len(pool)), replace=False)])]
        while todo:
            node, level, rows = todo.pop()
            wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if level == depth or not len(wide):
                length[t, node] = level + path_mean(len(rows))
                continue
            c = rng.choice(wide)
            column[t, node], value[t, node] = c, rng.uniform(rows[:, c].min(), rows[:, c].max())
            left = rows[:, c] <= value[t, node]
            todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
    return column, value, length


def anomaly(rows: np.ndarray, forest: tuple[np.ndarray, np.ndarray, np.ndarray], n_rows: int) -> np.ndarray:
    """2 ** (-mean path / expected path): from 0 to 1, higher is odder."""
    column, value, length = forest
    tree, total = np.arange(column.shape[0])[None, :], np.zeros(len(rows))
    at = np.zeros((len(rows), column.shape[0]), np.int64)
    for _ in range(int(np.log2(column.shape[1] + 1))):
        c = column[tree, at]
        right = np.take_along_axis(rows, np.maximum(c, 0), 1) > value[tree, at]
        at = np.where(c < 0, at, 2 * at + 1 + right)
    total = length[tree, at].mean(1)
    return np.exp2(-total / max(path_mean(n_rows), 1e-9))


def judged(docs: DataFrame, labels: DataFrame, with_: Forest = Forest()) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``anomaly`` (null if there is no row to learn from), ``kept``."""
    stats = written(document_statistics(docs), "rule-statistics")
    placed = stats.where("n_words > 0").select("doc_id", *RATIOS).distinct().withColumn("place", F.xxhash64("doc_id", F.lit(with_.seed)))
    pool = np.array([[*r] for r in least_placed(placed, "place", with_.pool_rows, ["doc_id", *RATIOS]).select(*RATIOS).collect()])
    names = ["doc_id", *COUNTS]
    if len(pool) < 2:
        scores = stats.select(*names, F.lit(None).cast("double").alias("anomaly"))
    else:
        forests = [(width, grow(pool[:, :width], with_)) for width in (len(RATIOS), SIGNS)]
        sent = docs.sparkSession.sparkContext.broadcast((forests, min(with_.rows, len(pool))))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    rows = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in RATIOS])
                    odd = np.max([anomaly(rows[:, :width], forest, sent.value[1]) for width, forest in sent.value[0]], 0)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(odd)], [*names, "anomaly"])

        kinds = ", ".join(f"{c} {stats.schema[c].dataType.simpleString()}" for c in names)
        scores = written(stats.mapInArrow(work, f"{kinds}, anomaly double"), "rule-scores")
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    scores = scores.withColumn("base_failed", failed)
    limit = threshold(scores, labels, with_.spare)
    return scores.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("anomaly"), F.lit(0.0)) < F.lit(limit)))


def threshold(scores: DataFrame, labels: DataFrame, spare: float) -> float:
    """The least score step over which at most ``spare`` of the labelled good rows lie; infinite without both classes."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    step = F.floor(F.col("anomaly") * STEPS).cast("int").alias("step")
    rows = (scores.where("not base_failed and anomaly is not null").select("doc_id", step).join(marked, "doc_id")
            .groupBy("step").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n")).collect())  # STEPS + 1 rows at most
    good, bad = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for r in rows:
        good[r["step"]] += r["good"]
        bad[r["step"]] += r["n"] - r["good"]
    if not good.sum() or not bad.sum():
        return float("inf")
    over = good[::-1].cumsum()[::-1]  # good rows at this step or beyond
    return int(np.flatnonzero(over <= spare * good.sum())[0]) / STEPS


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, the base counts, base_failed, kept; and the anomaly score."""
    return judged(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
