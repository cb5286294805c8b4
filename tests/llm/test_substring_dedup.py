import hashlib
import re

from ledgerline.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rows(docs, width=13):
    """One result a row: rows of one id are judged each by their own text."""
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1) if i is not None else ():
            first[tuple(w[k : k + width])] = min(i, first.get(tuple(w[k : k + width]), i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute(docs, width=13):
    return {r[0]: r[1:] for r in brute_rows(docs, width)}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, covers int, TAG string").repartition(parts)
    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.report(df).collect()]) == order(brute_rows(docs))


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text) for r in rows])


def test_edges(spark):
    w = [f"w{i}" for i in range(60)]
    docs = [(5, None), (6, ""), (7, " \n "), (1, " ".join(w)), (2, " ".join(w)), (3, "x y " + "\t ".join(w[3:16]) + " z"), (4, " ".join(w[:12])), (8, " ".join(w[20:32]) + " q"), (9, "a " * 40), (10, "a " * 30), (11, " ".join(w[30:50] + w[3:20])), (12, "b " + "c" * 3000 + " " + " ".join(w[40:54])), (13, " ".join(w[:12]))]
    check(spark, docs)
    check(spark, docs, 1)


def test_pipeline_form_and_empty_table(spark):
    w = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, w, 9), (2, w, 9), (3, "new " + w + " end", 9), (None, w, 9), (4, "clean  text", 9)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in sd.remove_repeats(docs).collect()) == [(0, w, 9), (1, w, 9), (3, "new end", 7), (4, "clean  text", 9)]
    assert sd.report(docs.limit(0)).count() == 0


def test_repeated_and_null_ids_keep_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = [(1, a), (5, a), (5, b), (5, b), (5, "new " + a), (7, c + " " + b), (None, a), (None, None), (0, c[:30])]
    check(spark, docs)
    check(spark, docs, 1)
    df = spark.createDataFrame([(i, t, "y", 1, 2) for i, t in docs], "doc_id long, text string, _id string, _text int, doc_key int")
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in sd.remove_repeats(df).collect())
    assert kept == sorted([(1, a), (5, b), (5, b), (5, "new"), (7, c), (-1, a), (-1, ""), (0, c[:30])])
    assert sd.remove_repeats(df).columns == df.columns


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    docs = [(1, long), (2, "x " * 40 + long[200_000:400_000] + " y"), (3, "z" * 2_000_000 + " " + long[:5000]), (4, long)]
    check(spark, docs, 2)
