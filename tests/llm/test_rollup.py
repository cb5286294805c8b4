from pyspark.sql import functions as F

from ledgerline.llm import rollup
from ledgerline.llm import rollup as ru
from ledgerline.workdir import new_path

SCHEMA = "doc_id long, source string, lang string, text string, words int"


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_inserts_deletes_revisions_and_replays(spark):
    docs = spark.createDataFrame([(1, "a", "en", "one two 3", 9), (2, "a", "en", None, 9), (3, None, None, "x", 9), (4, "a", "en", "", 9)], SCHEMA)
    counts = rollup.count_documents(docs)
    r = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    added = rollup.signed(counts, "w", new=F.col("words"))
    assert r.commit("b1", added)
    assert totals(r) == {("a", "en", "w"): (3, 3), (None, None, "w"): (1, 1)}
    assert not r.commit("b1", added)
    assert totals(r)[("a", "en", "w")] == (3, 3)
    assert r.commit("b2", rollup.signed(counts.where("doc_id = 1"), "w", new=F.col("letters"), old=F.col("words")))
    assert totals(r)[("a", "en", "w")] == (3, 2)
    assert r.commit("b3", rollup.signed(counts.where("doc_id = 3"), "w", old=F.col("words")))
    assert totals(r) == {("a", "en", "w"): (3, 2)}
    assert r.commit("b4", added.limit(0)) and totals(r) == {("a", "en", "w"): (3, 2)}


def test_null_and_repeated_ids_follow_the_sql(spark, tmp_path):
    import duckdb

    rows = [(None, "a", "en", "one 2"), (None, "a", "en", "only null 3"), (None, "a", "en", "only null 3"), (5, "b", "en", "one 2"), (7, "c", "en", "x 9"), (7, "c", "en", "x 9"), (8, "c", "en", "x 9"), (None, "c", "de", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {(x.source, x.lang, x.tokenizer, x.n_docs, x.n_tokens) for x in rollup.op3_token_rollup(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(rollup.ORACLES["op3_token_rollup"]).fetchall())


def test_empty_rollup_and_uncommitted_batches(spark, tmp_path):
    r = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    assert totals(r) == {}
    docs = spark.createDataFrame([(None, "a", "en", "one two", 9), (2, "a", "en", "x " * 200_000, 9), (2, "a", "en", "y", 9)], SCHEMA)
    counts = rollup.count_documents(docs)
    added = rollup.signed(counts, "w", new=F.col("words"))
    added.groupBy(*rollup.KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{r.root}/batch=half")
    assert totals(r) == {}
    assert r.commit("half", added) and totals(r) == {("a", "en", "w"): (3, 200_003)}
    assert not r.commit("half", added) and totals(r) == {("a", "en", "w"): (3, 200_003)}


def _rows(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def _change(spark, source, docs, tokens):
    return spark.createDataFrame([(source, None, "t", docs, tokens)], "source string, lang string, tokenizer string, d_docs long, d_tokens long")


def test_a_residue_of_tokens_shows(spark, tmp_path):
    rollup = ru.Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("a", _change(spark, "s", 1, 5))
    rollup.commit("b", _change(spark, "s", -1, -3))
    assert _rows(rollup) == {("s", None, "t"): (0, 2)}
    rollup.commit("c", _change(spark, "s", 0, -2))
    assert _rows(rollup) == {}


def test_compaction_keeps_totals_and_ids(spark, tmp_path):
    root = tmp_path / "r"
    rollup = ru.Rollup(spark, f"file://{root}")
    assert not rollup.compact()
    for i in range(4):
        assert rollup.commit(f"b{i}", _change(spark, "s", 1, i))
    want = _rows(rollup)
    assert rollup.compact() and not rollup.compact() and _rows(rollup) == want == {("s", None, "t"): (4, 6)}
    assert sorted(p.name for p in root.iterdir()) == ["compact=000000001"]
    assert not rollup.commit("b2", _change(spark, "s", 1, 2)) and _rows(rollup) == want
    assert rollup.commit("b4", _change(spark, "q", 1, 1)) and rollup.compact()
    assert _rows(rollup) == want | {("q", None, "t"): (1, 1)} and not rollup.commit("b4", _change(spark, "q", 1, 1))


def test_a_crash_around_the_rename_changes_nothing(spark, tmp_path, monkeypatch):
    import shutil

    root = tmp_path / "r"
    rollup = ru.Rollup(spark, f"file://{root}")
    rollup.commit("a", _change(spark, "s", 1, 5))
    with monkeypatch.context() as m:
        m.setattr(rollup, "_take", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        try:
            rollup.compact()
        except KeyboardInterrupt:
            pass
    assert _rows(rollup) == {("s", None, "t"): (1, 5)}
    shutil.copytree(root / "batch=a", tmp_path / "kept")
    assert rollup.compact()
    shutil.copytree(tmp_path / "kept", root / "batch=a")  # as if it had not been deleted
    assert _rows(rollup) == {("s", None, "t"): (1, 5)}


def test_bpe_rollup_counts_as_tiktoken(spark):
    import base64
    from collections import Counter

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path, docs, tokens = "/root/testdata/sf0.001", Counter(), Counter()
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        docs[r.source, r.lang] += 1
        tokens[r.source, r.lang] += len(own.encode_ordinary(r.text or ""))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ru.bpe_rollup(spark, path).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}
