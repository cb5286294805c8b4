import hashlib

import numpy as np

from ledgerline.llm import suffix_dedup as sd


def brute(docs, width=50):
    """One result a row: rows of one id are judged each by their own text."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in raw:
        for k in range(len(b) - width + 1) if i is not None else ():
            first[b[k : k + width]] = min(i, first.get(b[k : k + width], i))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - width + 1) if i is not None else ():
            if first[b[k : k + width]] < i:
                gone[k : k + width] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, bucket int, tag int").repartition(parts)
    assert order([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.report(df).collect()]) == order(brute(docs))


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text) for r in rows])


def test_edges(spark):
    t = "".join(chr(97 + i) for i in np.random.default_rng(4).integers(0, 26, 400))
    docs = [(5, None), (6, ""), (1, t), (2, t), (3, "xx" + t[30:80] + "yy"), (4, "zz" + t[30:79] + "é"), (7, "a" * 300), (8, "a" * 49), (9, "b" + "a" * 60), (10, t[100:200] + "-" + t[150:250]), (11, "é" * 40), (12, "é" * 25 + "x"), (13, t[:49]), (14, t[:49])]
    check(spark, docs)
    check(spark, docs, 1)


def test_empty_table_and_null_key(spark):
    docs = spark.createDataFrame([(None, "q" * 80), (1, "q" * 80)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in sd.report(docs).collect()) == [(0, 0), (1, 0)]
    assert sd.report(docs.limit(0)).count() == 0


def test_run_index_rows_and_samples():
    texts = [b"a" * 70, b"b" + b"a" * 60, b"banana" * 12, b"c" * 51]
    index = sd.RunIndex(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts]), np.array([4, 3, 2, 1]))
    least, begin = index.stream()
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            assert least[begin[i] + k] == min(d for d, u in zip([4, 3, 2, 1], texts) if t[k : k + 50] in u)
    assert len(index.heads) == len(index.samples) < sum(map(len, texts)) / 2


def test_repeated_and_null_ids_keep_other_texts(spark):
    a, b = ("".join(chr(97 + i) for i in np.random.default_rng(k).integers(0, 26, 150)) for k in (7, 8))
    check(spark, [(1, a), (5, a), (5, b), (5, b), (5, "new" + a[:90]), (7, a[20:80] + b[30:100]), (None, a), (None, None), (0, a[:49])])


def test_very_long_texts(spark):
    long = "".join(chr(97 + i) for i in np.random.default_rng(9).integers(0, 26, 400_000))
    check(spark, [(1, long), (2, "x" * 90 + long[100_000:200_000] + "y"), (4, long)], 2)
