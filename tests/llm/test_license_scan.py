import random
import re

from ledgerline.llm import license_scan as ls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, templates):
    out = {}
    for name, text in templates:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        n = len(w) - k + 1
        for doc, t in docs:
            v = words(t)
            grams = [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
            hits = []
            for s in range(max(1, len(grams) - n + 1)) if grams else ():
                held = len(own & set(grams[s : s + n])) / len(own)
                if held >= 0.75:
                    hits.append((held, -s))
            if hits:
                out[doc, name] = (round(max(hits)[0], 9), -max(hits)[1], len(hits))
    return out


def check(spark, docs, templates):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word, r.n_windows) for r in ls.scan(df, templates).collect()}
    assert got == brute(docs, templates)
    return got


def test_edited_notices(spark):
    rng = random.Random(8)
    docs = [(500, None), (501, ""), (502, "MIT"), (503, ls.TEMPLATES[1][1]), (504, ls.TEMPLATES[1][1][:-60])]
    for i in range(80):
        notice = rng.choice(ls.TEMPLATES)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            notice[rng.randrange(len(notice))] = rng.choice(["x", "the", "License"])
        docs.append((i, " ".join(rng.choices("abcdefgh", k=rng.choice([0, 3, 50])) + notice + rng.choices("abcdefgh", k=rng.choice([0, 9])))))
    assert len(check(spark, docs, [*ls.TEMPLATES, ("short", "a b"), ("none", " ")])) > 40


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text) for r in rows], ls.TEMPLATES)


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string"), ls.TEMPLATES).count() == 0
