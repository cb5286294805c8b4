import random
import re
from collections import Counter

from ledgerline.llm import decontaminate as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = {}
    for item, text in items:
        w = words(text)
        if not w or item is None:
            continue
        k = min(5, len(w))
        own = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for doc, t in docs:
            v, hits = words(t), []
            for s in range(len(v) - len(w) + 1):
                there = Counter(tuple(v[i : i + k]) for i in range(s, s + len(w) - k + 1))
                both = sum((own & there).values())
                sim = both / (sum(own.values()) * 2 - both)
                if sim >= 0.75:
                    hits.append((sim, -s))
            there = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            if k <= len(v) < len(w):  # a text shorter than the item is one window
                both = sum((own & there).values())
                sim = both / (sum(own.values()) + sum(there.values()) - both)
                hits += [(sim, 0)] if sim >= 0.75 else []
            if hits:
                out[doc, item] = (round(max(hits)[0], 9), -max(hits)[1], len(hits))
    return out


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_windows) for r in dc.matches(d, b).collect()}
    assert got == brute([x for x in docs if x[0] is not None], items)
    return got


def test_edited_passages_in_noise(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 14, 30, 30, 59])))) for i in range(12)] + [(90, None), (91, " "), (None, "a b c d e f")]
    docs = [(1000, None), (1001, ""), (None, items[3][1])]
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 40, 200]))
        passage = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p = rng.randrange(len(passage))
            passage[p : p + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + [x.upper() for x in passage] + w[at:])))
    assert len(check(spark, docs, items)) > 20


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in dc.op5_decontaminate(spark, path).collect()}
    joined = {i: " ".join(words(t)) for i, t in docs}
    assert {(d, i) for i, t in items for d, w in joined.items() if " ".join(words(t)) in w} <= got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.matches(docs, items.limit(0)).count() == 0
    assert dc.matches(docs.limit(0), items).count() == 0
    assert dc.clean(docs, items).count() == 0 and dc.clean(docs, items.limit(0)).count() == 1


def test_texts_shorter_than_an_item(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([6, 9, 20, 30, 59])]
    docs = []
    for i, text in items:
        w = text.split()
        for cut in (1, 2, 4, 14):
            docs += [(100 * i + cut, " ".join(w[cut:])), (100 * i + cut + 50, " ".join(w[:-cut]))]
        docs.append((100 * i + 40, " ".join([*w[:3], *w[4:]])))
    shorter = {}
    for item, text in items:
        own = grams(words(text))
        for doc, t in docs:
            there = grams(words(t))
            both = sum((own & there).values())
            if 0 < sum(there.values()) < sum(own.values()) and both / (sum(own.values()) + sum(there.values()) - both) >= 0.75:
                shorter[doc, item] = (round(both / (sum(own.values()) + sum(there.values()) - both), 9), 0, 1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_windows) for r in dc.matches(d, b).collect()}
    assert got == brute(docs, items) and shorter.items() <= got.items()
    assert got[404, 4] == (round(51 / 55, 9), 0, 1)
    assert {r.doc_id for r in dc.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in got}


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_rows_are_judged_by_their_texts(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(None, "a " + item), (None, "clean text of its own here"), (3, item + " b"), (3, "other words and more of them"), (4, None), (5, ""), (5, item)]
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, _leaked int, gone_id int, place int")
    b = spark.createDataFrame([(1, item, "x")], "item_id long, text string, shingles string")
    kept = dc.clean(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in docs if not t or item not in t)


def test_many_items_and_shuffled_tables(spark, monkeypatch):
    """Recall of exact similarity 0.75 and more among many items of few lengths, with the item tables shuffled."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([12, 25])))) for i in range(400)]
    docs = []
    for i in range(160):
        passage = items[rng.randrange(400)][1].split()
        for _ in range(rng.choice([0, 1, 1])):
            passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        docs.append((i, " ".join([*rng.choices(vocabulary, k=30), *passage, *rng.choices(vocabulary, k=9)])))
    want = brute(docs, items)
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_windows) for r in dc.matches(d, b).collect()}
    assert len(want) > 50 and got.keys() <= want.keys() and len(got) >= 0.98 * len(want)


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = "x " * 150_000 + item + " y" * 1000
    check(spark, [(1, text), (2, "z" * 1_000_000)], [(1, item)])
