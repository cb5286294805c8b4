import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerline.llm import collocations as co

TEXT = "lang string, text string"


def brute(docs, min_count, top=co.TOP):
    """Everything counted in plain Python."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    often = {k: c for k, c in f.items() if c >= min_count and len(k[1]) > 1}

    def inside(p, q):
        return any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

    rows = {}
    for (lang, p), a in often.items():
        if any(g == lang and len(q) > len(p) and 100 * c >= 100 * a and inside(p, q) for (g, q), c in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((g, i, x[2].decode(), -x[1], x[3], x[4], n[g], -x[0]) for g, xs in rows.items() for i, x in enumerate(sorted(xs)[:top], 1))


def mined(spark, docs, **kw):
    return sorted(tuple(r) for r in co.collocations(spark.createDataFrame(docs, TEXT), **kw).collect())


def test_equals_brute_force_with_ties_separators_and_odd_words(spark):
    rng, words = random.Random(13), ["Ab", "ab", "ß", "é", "x\x00y", "the", "of", "日本", "w" * 3000, "ÀB", "\xa0", "q"]
    passage = "new york stock exchange of the ab"
    docs = [(None, None), ("en", ""), ("en", " \t\n.;"), (None, "a b a b a b")]
    for i in range(120):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\t", "\n", "\x0b", "!"]) for _ in range(rng.choice([1, 9, 60])))
        docs.append((rng.choice(["en", "de", None, "und", ""]), text + rng.choice(["", ". " + passage, " " + passage])))
    docs += docs[10:20]
    want = brute(docs, 6)
    assert mined(spark, docs, min_count=6) == want and len(want) > 50
    assert mined(spark, docs, min_count=6, top=5) == brute(docs, 6, 5)


def test_runs_that_spill_and_burst_sum_to_the_same(spark):
    rng = np.random.default_rng(3)
    windows = rng.integers(1, 9, (5000, 3)).astype(np.uint64)
    windows[rng.random(5000) < 0.3, 2] = 0
    want = Counter(map(tuple, windows.tolist()))
    trie, runs = co.HatTrie(3, 5, np.array([2, 3], dtype=np.uint64), limit=60, burst=4), []
    for part in np.array_split(windows, 40):
        trie.add(part)
        if trie.size > trie.limit:
            runs += trie.spill(trie.limit // 2)
            assert trie.size <= trie.limit // 2
    assert any(node.kids for node in trie.roots.values())
    runs += trie.spill(0)
    assert trie.size == 0 and len(runs) > 5
    got = Counter()
    for _, payload in runs:
        keys, counts = co.read_run(payload)
        assert [tuple(k) for k in keys.tolist()] == sorted(set(map(tuple, keys.tolist())))
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            got[tuple(k)] += n
    assert got == want
    # A prefix partition has all that begins with the same two words.
    homes = {}
    for part, payload in runs:
        for k in co.read_run(payload)[0].tolist():
            assert homes.setdefault(tuple(k[:2]), part) == part


def test_tight_limits_give_the_same_rows(spark):
    docs = [("en", " ".join(random.Random(i).choices("abcdef", k=300))) for i in range(20)]
    assert mined(spark, docs, min_count=20, limit=3) == brute(docs, 20)


def test_products_past_64_bits_are_exact(spark):
    assert spark.sql("SELECT CAST(CAST(4000000000000 AS DECIMAL(19,0)) * CAST(9000000000000000 AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0)) AS DECIMAL(38,0)) div CAST(7000000000000 AS DECIMAL(38,0)) AS x").first().x == 1000 * 4 * 10**12 * 9 * 10**15 // (7 * 10**12)


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    docs = [("en", "big apple pie. " * 10)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], TEXT + ", f long, key long, rank long")
    assert sorted(tuple(r) for r in co.collocations(df, min_count=5).collect()) == brute(docs, 5)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    df = co.op13_collocations(spark, path)
    want = con.sql(co.ORACLES["op13_collocations"])
    assert df.columns == want.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(want.fetchall()) and len(got) > 10
