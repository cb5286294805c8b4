import random
import zlib

from ledgerline.llm import toxicity as tx

PATH = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_columns(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    rows = tx.op2_toxicity(spark, PATH).collect()
    assert len(rows) == spark.read.parquet(f"{PATH}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    own = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, _, y in own if y], [s for s, _, y in own if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / len(ones) / len(zeros)
    assert auc > 0.9
    flagged = [y for _, p, y in own if p]
    assert sum(flagged) / len(flagged) > 0.9 and sum(flagged) / len(ones) > 0.8


def test_swaps_lower_scores_of_neutral_mentions(spark):
    rng = random.Random(2)
    filler = [f"word{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = rng.choices(filler, k=8) + (["idiot"] if toxic and rng.random() < 0.7 else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.1) else []) + (["christians"] if rng.random() < 0.1 else [])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    free, fair = (tx.fit(docs, labels, counterfactual=c) for c in (0.0, 20.0))
    a, b = "worda about muslims", "worda about christians"
    assert free.score(a) - free.score(b) > 0.3
    assert abs(fair.score(a) - fair.score(b)) < 0.15
    assert fair.score("an idiot") > 0.6


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "x", 3), (1, None, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tx.judge(docs, tx.learn(docs, labels)).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert tx.judge(docs.limit(0), tx.Model({}, 0.0)).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    assert tx.learn(docs, labels).weights == {}


def plain_score(model, text):
    """The score word by word: letters only, lower case, each word once, and its beginnings of five to eight letters."""
    import math
    import re

    features = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        features.add(w)
        features.update(w[:n] + "-" for n in (5, 6, 7, 8) if len(w) > n)
    z = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(features))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_and_filter_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = tx.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = tx.judge(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.7)
    clean = {r.doc_id: r.text for r in tx.keep_clean(docs, model).collect()}
    assert clean == {r.doc_id: texts[r.doc_id] for r in rows if r.score < 0.7}


def test_a_score_of_exactly_the_threshold_is_toxic(spark, monkeypatch):
    model = tx.Model({"bad": 1.0}, 0.0)
    at = model.score("bad")
    monkeypatch.setattr(tx, "THRESHOLD", at)
    docs = spark.createDataFrame([(1, "bad"), (2, "good"), (None, "bad"), (2, "bad"), (3, None), (4, "bad " * 200_000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.predicted) for r in tx.judge(docs, model).collect()) == [(0, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1)]
    assert sorted((r.doc_id, r.text or "") for r in tx.keep_clean(docs, model).collect()) == [(2, "good"), (3, "")]


def test_default_strength_lowers_false_positives_on_neutral_mentions(spark):
    rng = random.Random(6)
    filler = [f"word{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        words = rng.choices(filler, k=8) + (["idiot"] if toxic and rng.random() < 0.75 else []) + (["muslims"] if rng.random() < (0.75 if toxic else 0.08) else []) + (["christians"] if rng.random() < 0.08 else [])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    free, fair = tx.fit(docs, labels, counterfactual=0.0), tx.fit(docs, labels)
    neutral = [" ".join(rng.choices(filler, k=8) + ["muslims"]) for _ in range(300)]
    wrong = [sum(m.score(t) >= 0.5 for t in neutral) for m in (free, fair)]
    gap = [sum(abs(m.score(t) - m.score(t.replace("muslims", "christians"))) for t in neutral) for m in (free, fair)]
    assert wrong[1] <= wrong[0] and gap[1] < 0.7 * gap[0]
