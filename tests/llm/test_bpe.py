import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from ledgerline.llm import bpe

TEXTS = ["", None, "The theatat is trash!!  It's  fine\n\n x", "ñ€漢字 🙂🙂 ÄÖÜß", "a" * 3000, "  \t ", "aaab" * 50 + " 123456", "the", "the", "<|endoftext|>"]


def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken_and_round_trips(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    codec = bpe.default_codec(spark)
    enc = reference()
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, codec), codec).collect()}
    marks = {r.doc_id: r for r in bpe.fingerprints(docs, codec).collect()}
    assert len(rows) == len(marks) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = enc.encode_ordinary(t or "")
        assert rows[i].ids == want
        assert bytes(rows[i].decoded) == (t or "").encode()
        assert marks[i].n_tokens == len(want)
        assert marks[i].ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert marks[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_given_documents_equal_tiktoken(spark):
    path = "/root/testdata/sf0.001"
    enc = reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in bpe.op1_bpe(spark, path).collect():
        want = np.array(enc.encode_ordinary(texts[r.doc_id] or ""), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.fingerprints(docs, bpe.default_codec(spark)).count() == 0


def test_perfect_hash_is_minimal_and_checks_keys():
    keys = [f"k{i}".encode() for i in range(1000)]
    table = bpe.PerfectHash(keys, np.arange(1000, dtype=np.uint32))
    assert table.find(keys) == list(range(1000))
    assert sorted(table.keys) == sorted(keys)
    assert table.find([b"none", b""]) == [-1, -1]


def test_perfect_hash_of_many_sizes():
    for n in [*range(1, 60), 100, 333, 1000, 2500, 5000]:
        keys = [f"k{i}".encode() for i in range(n)]
        table = bpe.PerfectHash(keys, np.arange(n, dtype=np.uint32))
        assert table.find(keys) == list(range(n)) and sorted(table.keys) == sorted(keys)
        assert table.find([b"none", b""]) == [-1, -1]
    assert bpe.PerfectHash([], np.empty(0, dtype=np.uint32)).find([b"x"]) == [-1]


def test_perfect_hash_takes_another_seed(monkeypatch):
    monkeypatch.setattr(bpe, "TRIES", 64)
    keys = [f"k{i}".encode() for i in range(50)]
    table = bpe.PerfectHash(keys, np.arange(50, dtype=np.uint32))
    assert table.find(keys) == list(range(50))


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "one two", 1), (7, "one two", 1), (7, "three", 1), (7, "one two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.decoded_sha256) for r in bpe.fingerprints(docs, bpe.default_codec(spark)).collect())
    assert got == sorted((i or 0, hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows)
