import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfcast.llm.quality import COUNTS, Forest, anomaly, grow, path_mean, quality_digest
from shelfcast.llm.tables import least_placed

from . import hard_cases as H

SF = "/root/testdata/sf0.1"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, own = [], ""
    for c in text:
        if c in SPACE:
            out, own = out + [own] * bool(own), ""
        else:
            own += c
    return out + [own] * bool(own)


def brute(text):
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    counts = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]
    return (*counts, len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_counts_equal_plain_loops(spark):
    texts = [*H.texts(), "a b c d e a b c d e", "x\nx\n x\nx", "\n\n", "#*$ a|b <c>", "a b c d e f " * 30, "é\n" * 20]
    frame = H.with_odd_rows(spark, H.docs(spark, texts))
    got = sorted((str(r["doc_id"]), *(r[c] for c in COUNTS), r["base_failed"]) for r in quality_digest(frame, H.labels(spark, [])).collect())
    assert got == sorted((str(r["doc_id"]), *brute(r["text"] or "")) for r in frame.collect())


def test_without_labels_only_base_rules_reject(spark):
    frame = H.docs(spark, H.texts())
    assert quality_digest(frame, H.labels(spark, [(1, 1, 0)])).where("kept = base_failed").count() == 0
    assert quality_digest(frame.limit(0), H.labels(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables")
def test_forest_rejects_bad_and_spares_good(spark):
    got = quality_digest(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.mean() >= 0.99
    assert rows[rows.quality == 0].kept.mean() <= 0.2


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables")
def test_forest_rejects_texts_odd_by_one_statistic(spark):
    """Repeated lines, repeated windows under the base rule's fifth, and glued words, each without any other oddness."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(3)
    vocabulary = sorted({w for r in docs.where("text is not null").orderBy("doc_id").limit(300).collect() for w in words(r["text"]) if w.isalpha() and w.islower()})
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    lines = ["\n".join(" ".join(some(40)) + "\nRead more" for _ in range(12)) for _ in range(8)]
    windows = [" ".join(w + w[:41]) for w in (some(400) for _ in range(8))]
    glued = [" ".join("".join(some(6)) for _ in range(300)) for _ in range(8)]
    planted = H.docs(spark, lines + windows + glued, 10**9).select("doc_id", "text")
    all_labels = labels.select("doc_id", "quality").unionByName(planted.select("doc_id", F.lit(0).alias("quality")))
    got = quality_digest(docs.select("doc_id", "text").unionByName(planted), all_labels).join(all_labels, "doc_id").where("not base_failed").toPandas()
    own = got[got.doc_id >= 10**9].set_index("doc_id").sort_index()
    assert len(own) == 24
    assert [own.kept.loc[10**9 + i:10**9 + i + 7].mean() for i in (0, 8, 16)] == [0, 0, 0]
    assert got[got.quality == 1].kept.mean() >= 0.99


def test_anomaly_equals_a_plain_isolation_forest():
    """The same trees walked row by row, and scores from path lengths as defined."""
    rng = np.random.default_rng(7)
    pool = rng.normal(size=(500, 3))
    with_ = Forest(trees=16, rows=64)
    column, value, length = forest = grow(pool, with_)
    rows = np.concatenate([rng.normal(size=(60, 3)), [[9.0, 9.0, 9.0]]])

    def harmonic(n):
        return sum(1 / k for k in range(1, n))

    def plain(row):
        total = 0.0
        for t in range(with_.trees):
            node, depth = 0, 0
            while column[t, node] >= 0:
                node, depth = 2 * node + 1 + (row[column[t, node]] > value[t, node]), depth + 1
            assert length[t, node] >= depth
            total += length[t, node]
        return 2 ** -(total / with_.trees / (2 * harmonic(64) - 2 * 63 / 64))

    got = anomaly(rows, forest, 64)
    assert np.allclose(got, [plain(r) for r in rows], atol=0.01) and got.argmax() == len(rows) - 1
    # each split lies within the rows that reach it, and leaves carry the expected rest of the path
    leaves = length[column < 0]
    assert (leaves[leaves > 0] <= np.ceil(np.log2(64)) + path_mean(64)).all()


def test_pool_is_the_least_hashes_without_repeats(spark):
    frame = spark.createDataFrame([(i % 900, float(i % 900)) for i in range(4000)], "doc_id long, x double")
    placed = frame.distinct().withColumn("place", F.xxhash64("doc_id"))
    want = [r["doc_id"] for r in placed.orderBy("place", "doc_id").limit(20).collect()]
    assert [r["doc_id"] for r in least_placed(placed, "place", 20, ["doc_id"]).collect()] == want
    assert least_placed(placed, "place", 5000, ["doc_id"]).count() == 900
