import os
import zlib

import numpy as np
import pytest
from shelfcast.llm.toxicity import Ftrl, drop_toxic, features, fit_sparse, toxicity_digest, train
from shelfcast.llm.textgrid import byte_array

from . import hard_cases as H
import pyarrow as pa

TABLES = "/root/testdata"


def test_features_stay_inside_a_text():
    text, at = features(*byte_array(pa.array(["A b c", None, "b, c", ""])))
    own = {i: sorted(at[text == i]) for i in range(4)}
    assert len(own[0]) == 3 + 2 + 1 and len(own[2]) == 2 + 1 and not own[1] and not own[3]
    assert set(own[2]) < set(own[0])  # b, c and the pair b c


def test_update_equals_a_plain_loop():
    rows, labels = [np.array([3, 5]), np.array([5]), np.array([3, 9])] * 4, np.array([1, 0, 1] * 4)
    with_ = Ftrl(alpha=0.5, l1=0.2, l2=0.3, epochs=2)
    left, w, bias = fit_sparse(rows, labels, with_)
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == -1 else with_.l1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((with_.beta + n[i] ** 0.5) / with_.alpha + with_.l2)

    for _ in range(2):
        for own, y in zip(rows, labels):
            own = [*own, -1]
            ws = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(ws.values()))) - y
            for i in own:
                z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / with_.alpha * ws[i]
                n[i] = n.get(i, 0) + g * g
    want = {i: weight(i) for i in z if i != -1 and weight(i) != 0}
    assert dict(zip(left.tolist(), np.round(w, 9))) == {k: round(v, 9) for k, v in want.items()}
    assert bias == pytest.approx(weight(-1))


def toxic_table(spark):
    texts = [("you stupid idiot " if i % 3 == 0 else "a fine day ") + f"w{i} x{i % 7}" for i in range(300)]
    return H.docs(spark, texts), H.labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 1), (None, 1, 1), (5, None, None)])


def test_hard_rows_have_a_score(spark):
    docs, labels = toxic_table(spark)
    odd = H.with_odd_rows(spark, docs.unionByName(H.docs(spark, H.texts(), 1000)))
    got = toxicity_digest(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300)


def test_no_labels_reject_nothing(spark):
    docs, labels = toxic_table(spark)
    assert toxicity_digest(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity_digest(docs.limit(0), labels).count() == 0
    assert drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_stage_drops_toxic_rows_only(spark):
    docs, labels = toxic_table(spark)
    out = drop_toxic(docs, labels)
    assert out.schema.names == docs.schema.names
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(300) if i % 3}


def test_a_labelled_id_that_repeats_without_end(spark):
    docs, labels = toxic_table(spark)
    many = docs.where("doc_id = 3").crossJoin(spark.range(10_000).select()).select(docs.columns)
    model = train(docs, labels)
    again = train(docs.unionByName(many), labels)
    assert (model[0] == again[0]).all() and (model[1] == again[1]).all() and model[2] == again[2]


def test_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs, labels = toxic_table(spark)
    seen = []
    for with_ in (Ftrl(max_rows=40), Ftrl(max_bytes=1000)):
        model = train(docs, labels, with_)
        seen.append(model)
    assert all(m is not None for m in seen)
    assert train(docs, labels, Ftrl(max_bytes=8)) is None  # every text is over an eighth of it


@pytest.mark.parametrize("size, recall", [("sf0.1", 0.7), ("check_s", 0.95)])  # 3,200 and 16,500 labels to learn from
def test_held_out_accuracy(spark, size, recall):
    folder = f"{TABLES}/{size}"
    if not os.path.exists(folder):
        pytest.skip("test tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity_digest(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = got.where("held_out").join(labels, "doc_id").toPandas()
    hit = (rows.predicted == 1) & (rows.toxic == 1)
    assert hit.sum() >= recall * (rows.toxic == 1).sum() > 0
    assert hit.sum() >= 0.99 * (rows.predicted == 1).sum()
