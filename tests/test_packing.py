"""Sequential packing against plain Python."""

import random
import re

from ledgerline.operators import chunking as ch
from ledgerline.operators import corpus as co


def words(s):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", s) if w]


def pack(parts, most, sep, merge):
    done, cur, n = [], "", 0
    for x in parts:
        if not x.strip(" "):
            continue
        k = len(words(x))
        full = n >= most if merge else n > 0 and n + k > most
        if full:
            done.append(cur)
            cur, n = x, k
        else:
            cur, n = x if cur == "" else cur + sep + x, n + k
    return done + ([cur] if cur != "" else [])


def texts():
    rng = random.Random(7)
    out = []
    for i in range(60):
        paragraphs = []
        for _ in range(rng.randrange(6)):
            sentences = [" ".join(rng.choice(["alpha", "be", "c"]) for _ in range(rng.randrange(1, 40))) + rng.choice([".", "!", "?", ""]) for _ in range(rng.randrange(1, 7))]
            paragraphs.append(" ".join(sentences))
        out.append((i, rng.choice(["\n\n", "\n \n", "\n\n\n\n"]).join(paragraphs)))
    return [*out, (100, None), (101, ""), (102, "one"), (103, "w " * 3000)]


def paragraphs(t):
    return re.split(r"\n\s*\n", t)


def sentences(t):
    return re.split(r"(?<=[.!?])\s+", t)


def test_merge_paragraphs(spark):
    df = spark.createDataFrame(texts(), "k long, text string")
    got = {}
    for r in ch.merge_paragraphs(df, "k", "text", 100).collect():
        got.setdefault(r.k, {})[r.idx] = r.paragraph
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: p for k, t in texts() if t is not None and (p := pack(paragraphs(t), 100, "\n\n", True))}


def test_pack_sentences(spark):
    df = spark.createDataFrame(texts(), "k long, text string")
    got = {}
    for r in ch.pack_sentences(df, "k", "text", 60).collect():
        got.setdefault(r.k, {})[r.idx] = r.chunk
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: p for k, t in texts() if t is not None and (p := pack(sentences(t), 60, " ", False))}


def test_parent_child(spark):
    df = spark.createDataFrame(texts(), "k long, text string")
    got = {(r.k, r.parent_idx, r.child_idx): r.child for r in ch.parent_child(df, "k", "text", 150, 50, 20).collect()}
    want = {}
    for k, t in texts():
        for i, parent in enumerate(pack(paragraphs(t), 150, "\n\n", False) if t is not None else []):
            for j, child in enumerate(pack(sentences(parent), 50, " ", False)):
                if len(re.split(r"\s+", child)) >= 20:
                    want[k, i, j] = child
    assert got == want


def test_fingerprint_sees_changes_and_not_order(spark):
    rows = [(i, "AB"[i % 2], f"text {i}") for i in range(40)]
    mark = lambda rs: {r.company: (r.n, r.mark) for r in co.fingerprint(spark.createDataFrame(rs, "chunk_id long, company string, content string")).collect()}
    assert mark(rows) == mark(rows[::-1])
    changed = mark([*rows[:-1], (39, "B", "text")])
    assert changed["A"] == mark(rows)["A"] and changed["B"] != mark(rows)["B"]


def test_tables_of_pages(spark):
    two = "<h2>Cash <b>flow</b></h2><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td> 2 </td></tr></table><table><tr><td>x</td></tr></table><p><table><tr><td>u</td></tr><tr><td>v</td></tr></table>"
    df = spark.createDataFrame([(1, two), (2, None), (3, "no table"), (4, "<table><tr><td>broken")], "k long, html string")
    got = {(r.k, r.table_idx): (r.context, r.rows) for r in ch.extract_tables(df, "k", "html").collect()}
    assert got == {(1, 0): ("Cash flow", [["a", "b"], ["1", "2"]]), (1, 1): ("Cash flow", [["u"], ["v"]])}


def test_a_text_of_a_million_sentences(spark):
    import time

    text = "One two three. Four! Five six? " * 333_334
    began = time.time()
    got = ch.packed(ch._SENTENCE.split(text), 60, " ", False)
    assert time.time() - began < 30 and sum(x.count(" ") + 1 for x in got) == 333_334 * 6 and max(x.count(" ") + 1 for x in got) == 60
    assert got[:50] == pack(sentences(text[:40_000]), 60, " ", False)[:50]


def test_parts_without_words_and_long_parts():
    parts = ["\t", "a b c", " ", "d", "\t", "e f g h i j", "\n", "k"]
    for most in (1, 2, 3, 4, 100):
        for merge in (True, False):
            assert ch.packed(parts, most, "|", merge) == pack(parts, most, "|", merge)
