"""Places of many patterns against plain search, by the automaton and by anchors."""

import random
import re

import pytest

from ledgerline.functions import metric_names as mn
from ledgerline.operators import passages as ps
from ledgerline.operators import patterns as pt
from ledgerline.operators import records as rc
from ledgerline.plans import answers as an


def plain(docs, patterns, whole):
    out = []
    for key, text in docs:
        for p in {p for p in patterns if p and (not whole or re.search(r"\w", p))}:
            at = (text or "").find(p)
            while at >= 0:
                end = at + len(p)
                cut = lambda a, b: (a.isalnum() or a == "_") != (b.isalnum() or b == "_")
                if not whole or (cut(text[at - 1] if at else " ", p[0]) and cut(p[-1], text[end] if end < len(text) else " ")):
                    out.append((key, p, at + 1))
                at = text.find(p, at + 1)
    return sorted(out)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("limit", [1 << 20, 3])
def test_places_equal_plain_search(spark, whole, limit):
    rng = random.Random(7)
    alphabet = ["san", "jose", " ", "-", "é", "a", "aa", "&", "_", "日", "\n", ".", "york"]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40])))) for i in range(60)] + [(100, None), (101, "san jose")]
    patterns = ["", "san", "san jose", "a", "aa", "é", "&", "san-jose", "日", "york", "york", " a", "jose.", "_"]
    df = spark.createDataFrame(docs, "id long, text string")
    found = pt.occurrences(df, ["id"], "text", spark.createDataFrame([(p,) for p in patterns], "p string"), whole, limit)
    assert sorted((r.id, r.pattern, r.at) for r in found.collect()) == plain(docs, patterns, whole)


def test_no_nested_loops_and_many_places(spark):
    docs = spark.createDataFrame([(1, "offices in Place 77 and place 99999, a plant"), (2, "nowhere")], "id long, content string")
    many = spark.range(100_000).selectExpr("concat('place ', id) AS city")
    for limit in (pt.MAX_PATTERN_BYTES, 1000):
        low = docs.selectExpr("id", "lower(content) AS low")
        found = pt.occurrences(low, ["id"], "low", many, limit=limit)
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert {(r.pattern, r.at) for r in found.collect()} == {("place 77", 12), ("place 99999", 25)}
    rows = ps.location_mentions(docs, "id", "content", many).collect()
    assert {(r.city, r["at"], r.confidence) for r in rows} == {("place 77", 12, 0.8), ("place 99999", 25, 0.8)}


def test_every_name_of_every_metric_is_resolved(spark):
    assert len(mn.METRICS) == 54
    words = mn.vocabulary()
    vocabulary = spark.createDataFrame([(a, m, p) for a, m, _, _, p in words], "alias string, metric string, place int")
    asked = [(i, f"What was the {a.upper()} of X?") for i, (a, *_) in enumerate(words)] + [(900, "cashflows and sales, plus salesman"), (901, "nothing"), (902, None)]
    got = {r.query_id: r.metric for r in an.resolve_metric(spark.createDataFrame(asked, "query_id int, question string"), vocabulary).collect()}
    want = {}
    for i, q in asked:
        hits = [(-len(a), p, m) for a, m, _, _, p in words if re.search(rf"\b{re.escape(a)}\b", (q or "").lower())]
        if hits:
            want[i] = min(hits)[2]
    assert got == want and len(want) == len(words) + 1


def test_suggestions_by_precedence(spark):
    registry = spark.createDataFrame([(1, "ABC", "Alpha Corp", ["first"]), (2, "XAB", "Beta", ["abacus", None]), (3, "ZZ", "Crab", None)], "id int, ticker string, name string, aliases array<string>")
    queries = spark.createDataFrame([("ab",), ("ab",), ("",), ("q",)], "w string")
    assert sorted(tuple(r) for r in rc.suggest(queries, registry, 8).collect()) == [("ab", 1, 1), ("ab", 2, 1), ("ab", 3, 2)]
    assert sorted(tuple(r) for r in rc.suggest(queries, registry, 2).collect()) == [("ab", 1, 1), ("ab", 2, 1)]
