import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerline.llm import alignment as al

ODD = ["", " ", "  two  spaces\t\n", "<|endoftext|> </s> <0x41>", "naïve café", "日本語のテキスト", "🙂🙂‍🔥", "▁x", "a" * 700, "=" * 90, "ﬁ", "é", "\x00\x01", "​ z", "١٢٣ 4567", "don't I'LL", "　x", "\x85y\x1fz"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    byte_of = al._byte_of()

    def encode(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False)
        ys = b.encode(text)
        xs = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)]
        ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ys]
        whole = (" " + text).encode()
        return (xs, ys) if b"".join(t for _, t in xs) == whole == b"".join(t for _, t in ys) else ([], [])

    return encode


def brute(docs, encode):
    """Groups by merging both lists of ends; everything else by counting."""
    rows, seen = [], Counter()
    for doc, text in docs:
        xs, ys = encode(text)
        groups, links, i, j, p, q, ga, gb = [], Counter(), 0, 0, 0, 0, [], []
        while i < len(xs) or j < len(ys):
            if p <= q:
                ga.append(xs[i][0])
                p += len(xs[i][1])
                i += 1
            else:
                gb.append(ys[j][0])
                q += len(ys[j][1])
                j += 1
            if p == q:
                groups.append((ga, gb))
                links.update((a, b) for a in ga for b in gb)
                ga, gb = [], []
        seen.update(links.keys())
        rows.append((doc, len(xs), len(ys), groups, links))
    best = defaultdict(int)
    for (a, _), n in seen.items():
        best[a] = max(best[a], n)
    out = []
    for doc, n_a, n_b, groups, links in rows:
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if seen[k] == best[k[0]]), sum(n * seen[k] for k, n in links.items()), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), {(*k, n) for k, n in seen.items()}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n_a int, block string")


def test_odd_texts_repeats_and_nulls_equal_brute_force(spark, plain, monkeypatch):
    rng = random.Random(12)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (None, "one two"), (None, None), (3, "again three"), (3, "again three")]
    for i in range(100, 160):
        docs.append((i, "".join(rng.choice(["the ", "ing", "zq", "é", " ", "日", "x" * 40, "1", "\n", "Straße ", "..."]) for _ in range(rng.choice([1, 8, 90])))))
    shared = al.default_files(spark)
    want, pairs = brute(docs, plain)
    got = sorted((tuple(r) for r in al.summary(frame(spark, docs).repartition(3), shared).collect()), key=str)
    assert got == want and sum(r[4] > r[3] for r in got) > 20
    assert {tuple(r) for r in al.pair_counts(frame(spark, docs), shared).collect()} == pairs


def test_groups_join_to_the_ids_of_both(spark, plain):
    docs = [(1, "alignment of unbelievable words"), (2, None), (3, "日本")]
    for r in al.groups(frame(spark, docs), al.default_files(spark)).collect():
        xs, ys = plain(dict(docs)[r.doc_id])
        assert [i for g in r.groups for i in g.a] == [i for i, _ in xs] and [i for g in r.groups for i in g.b] == [i for i, _ in ys]


def test_every_code_point_is_tokenised_as_by_the_tokenizers_library(plain):
    with open(public.path("byte_bpe_50k.json"), "rb") as a, open(public.path("piece_bpe_32k.model"), "rb") as b:
        mine = al.Tokenizers(a.read(), b.read(), public.PATTERN)
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x30000, 3)]]
    rng = random.Random(1)
    for a in range(0, len(points), 400):
        text = "".join(x + rng.choice([" ", "a", "1", "  ", ".", "'s", "\n"]) for x in points[a : a + 400])
        other = Tokenizer.from_file(public.path("byte_bpe_50k.json")) if a == 0 else other  # noqa: F821
        other.encode_special_tokens = True
        assert mine._a.encode_ordinary(" " + text) == other.encode(" " + text, add_special_tokens=False).ids


def test_cuts_of_long_intervals_equal_those_of_a_merge():
    rng = np.random.default_rng(5)
    for share in (0.002, 0.05, 0.6):
        ends_a, ends_b, first_a, first_b, at = [], [], [0], [0], 0
        for size in (0, 1, 5, 4000, 2):
            if size:
                a, b = ({size, *np.flatnonzero(rng.random(size) < p).tolist()} - {0} for p in (share * 2, share))
                ends_a += sorted(at + x for x in a)
                ends_b += sorted(at + x for x in b)
                at += size
            first_a.append(len(ends_a))
            first_b.append(len(ends_b))
        x, y = al.shared_cuts(*map(np.array, (ends_a, ends_b, first_a, first_b)))
        both = sorted(set(ends_a) & set(ends_b))
        assert np.array(ends_a)[x].tolist() == both == np.array(ends_b)[y].tolist()


def test_empty_table(spark):
    assert al.summary(frame(spark, []), al.default_files(spark)).count() == 0


def test_query_equals_brute_force(spark, plain):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in al.op12_alignment(spark, path).collect()), key=str) == brute(docs, plain)[0]
