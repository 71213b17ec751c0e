import re
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow as pa
import pytest

from shelfcast.llm import audit as A
from shelfcast.llm import catalog
from shelfcast.llm import matrix as M

from . import hard_cases as H

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    rows = [(d, p or "", t or "") for d, t, p in rows]
    first = {}
    for d, _, t in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    docs = []
    for d, p, t in rows:
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (d is None or first[t] < d)}
        docs.append((p, {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        left = list(docs)
        for p in {d[0] for d in docs}:
            for step in range(1, 6):
                out[p, order, step] = Counter()
        for step, letter in enumerate(order, 1):
            gone = [d for d in left if letter in d[1]]
            left = [d for d in left if letter not in d[1]]
            for p, _, is_good, is_toxic in gone:
                out[p, order, step].update(removed=1, good_lost=int(is_good), toxic_lost=int(is_toxic))
            for d in left:
                out[d[0], order, step]["kept"] += 1
            for d in docs:
                out[d[0], order, step].update(redundant=int(letter in d[1] and bool(d[1] & set(order[:step - 1]))), unique_fails=int(d[1] == {letter}))
    shapley = Counter()
    for (p, order, step), c in out.items():
        shapley[p, order[step - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return sorted((p, order, step, *(c[n] for n in names), shapley[p, order[step - 1]]) for (p, order, step), c in out.items())


def documents(spark, small_shards=True):
    long = " ".join(f"w{i % 230}x" for i in range(260))
    texts = [*H.texts(40), long, long + " \n", long, long + " Z" * 4, "A" * 10 + " b", "a$b", "x|", "BIG " * 300, "dup dup", "dup dup", None, None]
    frame = H.docs(spark, texts)
    langs = ["en", "de", None, ""]
    rows = [(r["doc_id"], r["text"], langs[i % 4], r["source"], r["n_chars"], None, 0.5, "r", None) for i, r in enumerate(frame.collect())]
    rows += [rows[0], (None, "no id", None, *rows[0][3:]), (None, long, "de", *rows[0][3:]), (None, "no id", None, *rows[0][3:])]
    return spark.createDataFrame(rows, H.DOCS)


LABELS = [(d, int(d % 3 > 0), int(d % 5 == 0)) for d in range(0, 60, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (900, 1, 1)]


@pytest.mark.parametrize("shard_bytes", [200, 1 << 24])
def test_equals_all_orders_played_out(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(M, "SHARD_BYTES", shard_bytes)
    frame, marks = documents(spark).repartition(3), H.labels(spark, LABELS)
    got = A.filter_audit(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute([(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()], [(d, q, t) for d, q, t in LABELS if d is not None])


def test_sql_gives_the_same(spark):
    frame = documents(spark)
    got = sorted(map(tuple, A.filter_audit(frame, H.labels(spark, LABELS)).collect()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.execute("create table labels (doc_id bigint, quality bigint, toxic bigint)")
    con.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()])
    con.executemany("insert into labels values (?, ?, ?)", LABELS)
    names = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert got == sorted(con.sql(f"select {names} from ({catalog.SQL['op11_filter_audit']})").fetchall())


def test_empty_tables(spark):
    assert A.filter_audit(H.docs(spark, []), H.labels(spark, [])).count() == 0
    only = A.filter_audit(H.docs(spark, [None, ""]), H.labels(spark, []))
    assert sorted(map(tuple, only.collect())) == brute([(0, None, "en"), (1, "", "en")], [])


def test_a_text_that_fills_many_partitions(spark):
    frame = H.docs(spark, ["same old text"] * 3000 + [f"own {i}" for i in range(200)]).repartition(7)
    cells = {r["bits"]: r["n"] for r in A.with_labels(A.failures(frame, frame["lang"]), H.labels(spark, [])).collect()}
    assert cells == {1: 201, 17: 2999}


def test_matrix_holds_every_word_under_one_number(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 500)
    frame = H.with_odd_rows(spark, H.docs(spark, H.texts(30))).repartition(4)
    kept = lambda b: pa.RecordBatch.from_arrays([b.column("doc_id")], ["doc_id"])
    matrix, numbers, folder = M.term_matrix(frame.select("doc_id", "text"), kept)
    word_of = {r["id"]: r["word"] for r in numbers.collect()}
    texts = [r["text"] or "" for r in frame.collect()]
    words = {w for t in texts for w in WORD.findall(t)}
    assert len(word_of) == len(words) and sorted(word_of.values()) == sorted(words)
    rows = []
    for r in matrix.collect():
        starts, column, counts = M.csr_of(folder, r['shard'])
        assert r["n_rows"] == len(starts) - 1 and r["nnz"] == len(column)
        for a, z in zip(starts.tolist(), starts[1:].tolist()):
            assert (column[a + 1:z] > column[a:z - 1]).all() if z - a > 1 else True
            rows.append({word_of[int(c)]: int(n) for c, n in zip(column[a:z], counts[a:z])})
    plain = [dict(Counter(WORD.findall(t))) for t in texts]
    key = lambda d: sorted(d.items())
    assert sorted(rows, key=key) == sorted(plain, key=key)


def test_words_of_one_batch():
    texts = ["a b a", None, "", "  ", "\x1c\x85 a b", "x" * 100_000 + " x"]
    words, starts, index, counts = M.counted(pa.array(texts))
    got = [{words[int(i)].as_py(): int(c) for i, c in zip(index[a:z], counts[a:z])} for a, z in zip(starts, starts[1:])]
    assert got == [dict(Counter(WORD.findall(t or ""))) for t in texts]
