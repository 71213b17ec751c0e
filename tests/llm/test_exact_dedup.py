import hashlib
import re

from shelfcast.llm.exact_dedup import dedup_digest, distinct_documents

from . import hard_cases as H


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(((own[3], min(g)[3], len(g), own[3] == min(g)[3], hashlib.sha256(norm.encode()).hexdigest())
                   for norm, g in groups.items() for own in g), key=str)


def same(frame):
    got = sorted((tuple(r) for r in dedup_digest(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in frame.collect()])


def test_hard_rows(spark):
    same(H.with_odd_rows(spark, H.docs(spark, [*H.texts(), "a b", "ab", "a  b", "A b"])))
    same(H.docs(spark, []))


def test_a_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        frame = H.docs(spark, ["hot text" + " " * (i % 5) for i in range(900)] + [f"own {i}" for i in range(900)]).repartition(5)
        same(frame)
        assert distinct_documents(frame).count() == 901
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_document_of_a_group_stays(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, H.texts()))
    out = distinct_documents(frame)
    assert out.schema.names == frame.schema.names
    want = {(w[1], w[4]) for w in brute([(r["doc_id"], r["text"]) for r in frame.collect()])}
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(k) for k, _ in want)
