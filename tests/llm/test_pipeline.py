import corpus_pipeline
from shelfcast.llm.secrets import masked, secret_spans

from . import hard_cases as H
from .test_exact_dedup import brute as copies
from .test_jaccard import brute as classes
from .test_jaccard import near_copies
from .test_packing import gapless
from .test_repair import library


def tables(spark, folder):
    clean = [*near_copies(2, 5, 8), *[t for t in H.texts() if t is None or len(t) < 5000], "clean secret = 0123456789abcdef end of it", "word " * 1100]
    clean += [clean[0], clean[1].replace(" ", "  "), clean[0]]
    toxic = [f"you stupid idiot number {i}" for i in range(120)]
    docs = H.docs(spark, clean + toxic)
    docs.write.parquet(f"{folder}/documents.parquet")
    fine = [f"some fine words about {i}" for i in range(120)]
    H.docs(spark, fine, 5000).write.mode("append").parquet(f"{folder}/documents.parquet")
    marks = [(len(clean) + i, 1, 1) for i in range(100)] + [(5000 + i, 1, 0) for i in range(120)] + [(i, 1, 0) for i in range(len(clean))]
    H.labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    rows = {i: t for i, t in enumerate(clean)} | {5000 + i: t for i, t in enumerate(fine)}
    return rows


def test_stages_equal_plain_loops(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {w[0] for w in copies(list(rows.items())) if w[3]}  # the toxic ones are gone before
    kept = {w[0] for w in classes([(i, rows[i]) for i in kept]) if w[0] == w[1]}
    encode = library("byte_bpe_50k.json")
    want = {}
    for i in kept:
        text = rows[i] or ""
        want[i] = len(encode(masked(text, secret_spans(text)))) + 1
    got = {}
    for r in pieces:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    gapless(pieces, 1024)


def test_stages_keep_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.schema.names
