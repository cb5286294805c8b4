import re

import corpus_pipeline as cp
from ledgerline.llm import toxicity
from ledgerline.llm.tables import table

from tests.llm import test_decontaminate, test_near_dup, test_substring_dedup

PATH = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, PATH, "documents")
    columns = docs.columns
    model = toxicity.learn(docs, table(spark, PATH, "labels"))
    before = {r.doc_id: r.text for r in docs.collect()}

    def step(k, docs):
        out = cp.STAGES[k][1](spark, docs, PATH)
        out.write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    docs = step(0, docs)
    assert docs.columns == columns
    now = {r.doc_id: r.text for r in docs.collect()}
    assert now == {i: t for i, t in before.items() if model.score(t) < toxicity.THRESHOLD}
    docs, before = step(1, docs), now
    now = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and now == {i: before[i] for i, (_, _, kept) in test_near_dup.brute(list(before.items())).items() if kept}
    docs, before = step(2, docs), now
    now = {r.doc_id: r.text for r in docs.collect()}
    cut = test_substring_dedup.brute(list(before.items()))
    assert docs.columns == columns and set(now) == {i for i, (n, gone, _) in cut.items() if gone == 0 or gone < n}
    for i, t in now.items():
        assert t == before[i] if cut[i][1] == 0 else len(WORD.findall(t)) == cut[i][0] - cut[i][1]
    docs, before = step(3, docs), now
    now = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, PATH, "benchmark").collect()]
    likely = {i for i, t in before.items() if any(_may_hold(test_decontaminate.words(t), test_decontaminate.words(x)) for _, x in items)}
    leaked = {d for d, _ in test_decontaminate.brute([(i, before[i]) for i in likely], items)}
    assert docs.columns == columns and set(now) == set(before) - leaked
    out = {r.doc_id: r for r in step(4, docs).collect()}
    assert set(out) == set(now)


def _may_hold(text, item):
    grams = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
    return any(tuple(text[i : i + 5]) in grams for i in range(len(text) - 4))


def test_run_on_given_tables(spark):
    assert cp.run(spark, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_nulls_repeats_and_clashing_columns_through_all_stages(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(20))
    item = " ".join(f"q{i}" for i in range(30))
    other = " ".join(f"o{i}" for i in range(12))
    rows = [(None, None), (None, ""), (None, "a text " + item), (1, passage), (4, passage), (4, "unlike anything else at all in here"), (4, other + " " + passage), (9, "x " + item), (9, "clean and short"), (9, "clean and short"), (10, "z " * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _toxic int, tag int, _leaked int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert kept == sorted([(0, ""), (0, ""), (1, passage), (4, "unlike anything else at all in here"), (4, other), (9, "clean and short"), (9, "clean and short"), (10, "z " * 100_000)])
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(kept)
    docs = docs.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_last_stage_digests_equal_tiktoken(spark, tmp_path):
    import hashlib

    import numpy as np

    from tests.llm.test_bpe import reference

    docs = table(spark, PATH, "documents").limit(50)
    enc, texts = reference(), {r.doc_id: r.text for r in docs.collect()}
    rows = cp.tokenize(spark, docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
