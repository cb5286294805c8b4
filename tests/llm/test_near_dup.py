import re

import numpy as np

from ledgerline.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_rows(docs):
    """One result a row; a node is a row's set of shingles, so that rows of one id are judged each by their own text."""
    sets = [shingles(t) for _, t in docs]
    nodes = {}
    for k, (i, _) in enumerate(docs):
        if i is not None and sets[k]:
            nodes.setdefault(frozenset(sets[k]), []).append(i)
    names = list(nodes)
    parent = list(range(len(names)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = {}
    for k, s in enumerate(names):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(names):
        shared = {}
        for x in s:
            for j in where[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if j < k and 100 * both >= 75 * (len(s) + len(names[j]) - both):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    least = {}
    for k, s in enumerate(names):
        least[find(k)] = min(least.get(find(k), 1 << 62), *nodes[s])
    at = {s: k for k, s in enumerate(names)}
    out = []
    for k, (i, _) in enumerate(docs):
        c = least[find(at[frozenset(sets[k])])] if i is not None and sets[k] else i
        out.append((i, len(sets[k]), c, i is None or c == i))
    return out


def brute(docs):
    return {r[0]: r[1:] for r in brute_rows(docs)}


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, component_id int, TAG string")
    assert order((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.classes(df).collect()) == order(brute_rows(docs))


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text) for r in rows])


def test_edges_chains_and_copies(spark):
    rng = np.random.default_rng(1)
    chain = [f"w{i}" for i in rng.integers(0, 10**6, 80)]
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e"), (9, "é à x")]
    for k in range(12):  # each is near the next, the ends are not near each other
        docs.append((100 - k, " ".join(chain)))
        chain = chain[:40] + [f"n{k}a", f"n{k}b"] + chain[42:] if k % 2 else [f"m{k}"] + chain[1:]
    docs += [(200 + k, "same text here with more than five words") for k in range(50)]
    check(spark, docs)


def test_empty_table(spark):
    assert near_dup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = pool[:2000], pool[500:2500]
    offsets = np.array([0, 2000, 4000])
    regs = near_dup.registers(np.concatenate([a, b]), offsets)
    union = np.union1d(a, b)
    assert (near_dup.merge(regs[0], regs[1]) == near_dup.registers(union, np.array([0, len(union)]))[0]).all()
    guess = near_dup.likely_similarity(regs[:1], regs[1:], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(guess - 1500 / 2500) < 0.2


def test_null_and_repeated_ids_keep_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(1, a), (5, a), (5, b), (5, b), (7, b + " more"), (None, a), (None, None), (9, None), (9, ""), (9, c), (3, c + " end"), (-4, "x y")]
    check(spark, docs)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, gone_id int, _gone int")
    kept = near_dup.dedup(df)
    assert kept.columns == df.columns
    want = [(i, t) for (i, t), r in zip(docs, brute_rows(docs)) if r[3]]
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(want)
    assert (5, b) in want and (5, a) not in want


def family(rng, n, words, edits):
    """Copies of one text with up to ``edits`` words replaced, dropped or added; some edits are shared."""
    base = [f"b{i}" for i in range(words)]
    pool = [(int(rng.integers(words)), f"p{k}") for k in range(12)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            at, new = pool[int(rng.integers(12))] if rng.random() < 0.3 else (int(rng.integers(len(w))), f"n{int(rng.integers(10**6))}")
            at = min(at, len(w) - 1)
            w[at : at + int(rng.integers(0, 2))] = [new] * int(rng.integers(0, 2))
        out.append(" ".join(w))
    return out


def test_large_near_families_lose_no_link(spark):
    rng = np.random.default_rng(8)
    texts = family(rng, 220, 150, 9) + family(rng, 120, 60, 5) + family(rng, 60, 25, 3)
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_very_long_texts(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 120_000)]
    check(spark, [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[60_000:])), (4, "q" * 3_000_000), (5, "q" * 3_000_000 + " end")])
