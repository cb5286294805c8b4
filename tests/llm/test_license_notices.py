import random
import re

from ledgerline.llm import license_scan as ls


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, notices=ls.NOTICES):
    """Every window of every text by exact containment, then the best notice at each place."""
    out = {}
    for d, (_, t) in enumerate(docs):
        v, hits = words(t), []
        for i, (_, text, marks) in enumerate(notices):
            w = words(text)
            if not w:
                continue
            k = max(1, min(5, (len(w) + 1) // 5))
            own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            for s in range(max(1, len(v) - len(w) + 1)):
                part = v[s : s + len(w)]
                held = len(own & {tuple(part[j : j + k]) for j in range(len(part) - k + 1)}) / len(own)
                if held >= 0.75 and (not marks or set(marks) & set(part)):
                    hits.append((-held, -len(own), i, s, s + len(part)))
        owner = [None] * len(v)
        for held, _, i, s, e in sorted(hits):
            if all(o in (None, i) for o in owner[s:e]):
                owner[s:e] = [i] * (e - s)
                out.setdefault((d, i), []).append((-held, -s))
    return sorted(((docs[d][0], notices[i][0], round(max(h)[0], 9), -max(h)[1], len(h)) for (d, i), h in out.items()), key=str)


def scan(spark, docs, notices=ls.NOTICES):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, license string, containment int")
    return sorted(((r.doc_id, r.license, round(r.containment, 9), r.first_word, r.n_windows) for r in ls.scan_notices(df, notices).collect()), key=str)


def test_edited_notices_equal_brute_force(spark):
    rng = random.Random(9)
    docs = [(900, None), (901, ""), (902, "mit license"), (903, "under the MIT license"), (None, "Released under the MIT License"), (904, "Released under the MIT License")]
    docs += [docs[-1], (904, "Licensed under the ISC License")]
    for i in range(150):
        notice = rng.choice(ls.NOTICES)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            notice[rng.randrange(len(notice))] = rng.choice(["x", "the", "License,", "*"])
        docs.append((i, " ".join(rng.choices("abcdefgh", k=rng.choice([0, 3, 50])) + notice + rng.choices("abcdefgh", k=rng.choice([0, 9])))))
    got = scan(spark, docs)
    assert got == brute(docs) and len(got) > 110


def found(spark, *texts):
    return {(i, name) for i, name, *_ in scan(spark, list(enumerate(texts)))}


def test_edits_inside_names_are_found(spark):
    got = found(spark, "Licensed under the Apache Licence, Version 2.0", "This work is licensed under the GNU General Public Licence, version 3", "Licensed under the Apache License, v2.0")
    assert got == {(0, "Apache-2.0"), (1, "GPL-3.0"), (2, "Apache-2.0-short")}


def test_punctuation_edits_and_neighbours(spark):
    got = found(spark, "x Released under the MIT License, see", "published under the MIT license", "Licensed under CC BY-NC 4.0;", "Released under the BSD License.", "This work is licensed under the GNU Lesser General Public License, version 3", "Licensed under the Foo License", "This work is licensed under the GNU General Public License, version 2")
    assert got == {(0, "MIT"), (1, "MIT"), (2, "CC-BY-NC-4.0"), (4, "LGPL-3.0"), (6, "GPL-2.0")}


def test_full_texts_and_exactly_three_quarters(spark):
    texts = dict((n, t) for n, t, _ in ls.NOTICES)
    assert found(spark, "Copyright 2020 X. " + texts["MIT-text"], texts["BSD-3-Clause-text"], texts["BSD-2-Clause-text"]) == {(0, "MIT-text"), (1, "BSD-3-Clause-text"), (2, "BSD-2-Clause-text")}
    notices = [("four", "alpha beta gamma delta", ()), ("none", " ", ())]  # shingles of one word
    docs = [(0, "alpha beta gamma x"), (1, "alpha beta x y"), (2, "delta gamma beta alpha")]
    assert scan(spark, docs, notices) == brute(docs, notices) == [(0, "four", 0.75, 0, 1), (2, "four", 1.0, 0, 1)]


def test_long_text_with_many_notices_and_empty_table(spark):
    rng = random.Random(3)
    parts = [rng.choice(ls.NOTICES[:6] + ls.NOTICES[18:30])[1] if rng.random() < 0.1 else rng.choice("abcdefgh") for _ in range(9000)]
    docs = [(1, " ".join(parts)), (2, "license " * 20_000)]
    got = scan(spark, docs)
    assert got == brute(docs) and sum(r[4] for r in got) > 500
    assert scan(spark, []) == []


def test_registered_query_keeps_given_notices(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.license, round(r.containment, 9), r.first_word, r.n_windows) for r in ls.op8_license_scan(spark, path).collect()), key=str)
    assert got == brute(docs)
