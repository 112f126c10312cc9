"""Mixing: budgets, shares, repeats, and the choice of documents."""

import random

import pytest
from pyspark.sql import functions as F

from tablelens.llm import mixing
from tablelens.llm.mixing import Node, largest_exact, mix_sources, plan_budgets, spread

DOCS = "doc_id bigint, text string, lang string, source string"
WEIGHTS = "source string, target_share double, max_repeats int"


def leaves(*tokens, repeats=1, weights=None):
    return [Node(f"n{i}", (weights or [1.0] * len(tokens))[i], t, repeats) for i, t in enumerate(tokens)]


def test_shortages_go_to_siblings_first():
    left = Node("left", 0.5, children=leaves(10, 1000, weights=[0.5, 0.5]))
    right = Node("right", 0.5, children=leaves(1000))
    root = Node("root", 1.0, children=[left, right])
    assert spread(root, 400) == 0
    assert [c.budget for c in left.children] == [10, 190] and right.budget == 200
    left.children[1].tokens = 50
    assert spread(root, 400) == 0 and left.budget == 60 and right.budget == 340
    assert spread(root, 5000) == pytest.approx(5000 - 1060)


def test_budget_is_never_over_capacity_nor_lost():
    rng = random.Random(2)
    for _ in range(200):
        root = Node("r", 1.0, children=[Node(f"s{i}", rng.random(), children=leaves(*[rng.randint(0, 50) for _ in range(rng.randint(1, 4))], repeats=rng.randint(0, 3))) for i in range(4)])
        total = rng.randint(0, 600)
        short = spread(root, total)
        for s in root.children:
            for leaf in s.children:
                assert leaf.budget <= leaf.capacity() + 1e-6
        assert short + root.budget == pytest.approx(total) and root.budget == pytest.approx(sum(leaf.budget for s in root.children for leaf in s.children))
        assert short < 1e-6 or root.budget == pytest.approx(root.capacity())


def test_largest_exact_total():
    assert largest_exact({"a": (0.5, 100.0), "b": (0.3, 30.0), "c": (0.2, 0.0)}) == pytest.approx(30 * 0.8 / 0.3)
    plan = {s: (e, r) for s, _, _, e, r in plan_budgets([("a", "en", 100), ("b", "en", 10)], {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 5)}).leaves}
    assert plan == {"a": (0, 50), "b": (3, 0)}
    assert largest_exact({}) == 0.0 and plan_budgets([], {"a": (1.0, 1)}).leaves == []


def test_tree_by_hand():
    leaves = [("a", "en", 100), ("b", "en", 1000), ("a", "de", 50), ("c", "en", 400), ("x", "en", 9)]
    weights = {"a": (0.4, 1), "b": (0.2, 1), "c": (0.4, 2)}
    plan = plan_budgets(leaves, weights, 1000, {"a": "code", "b": "code"}, {"en": 0.5, "de": 0.5})
    nodes = {n[:3]: n[3:] for n in plan.nodes}
    # code 600: de can hold 50 of its 300, en takes the rest; there a holds 100 of 367, b takes the rest
    assert {k: v[3] for k, v in nodes.items()} == pytest.approx({
        ("code", None, None): 600, ("code", "de", None): 50, ("code", "de", "a"): 50, ("code", "en", None): 550, ("code", "en", "a"): 100, ("code", "en", "b"): 450,
        ("other", None, None): 400, ("other", "en", None): 400, ("other", "en", "c"): 400,
    })
    assert nodes["code", "de", "a"][:3] == pytest.approx((0.3, 300, 50)) and nodes["code", "en", "b"][:2] == pytest.approx((0.1, 100))
    assert {(s, lang): (e, r) for s, lang, _, e, r in plan.leaves} == {("a", "de"): (1, 0), ("a", "en"): (1, 0), ("b", "en"): (0, 450), ("c", "en"): (1, 0)}
    # more than the domain holds: the other domain takes it, up to its repeats
    plan = plan_budgets(leaves, weights, 2500, {"a": "code", "b": "code"}, {"en": 0.5, "de": 0.5})
    assert {n[0]: n[6] for n in plan.nodes if n[1] is None} == pytest.approx({"code": 1150, "other": 800})
    # a language that is not named has no part, unless "*" gives it one
    plan = plan_budgets(leaves, weights, 100, None, {"de": 1.0})
    assert {n[:3]: n[6] for n in plan.nodes if n[2]} == pytest.approx({("other", "de", "a"): 50, ("other", "en", "a"): 0, ("other", "en", "b"): 0, ("other", "en", "c"): 0})


def test_sources_keep_their_shares_whatever_the_domains():
    leaves = [(s, lang, n) for s, lang, n in [("a", "en", 500), ("a", "de", 10), ("b", "en", 40), ("b", "fr", 300), ("c", "de", 77)]]
    weights = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3)}
    for domains in (None, {"a": "x", "b": "x", "c": "y"}, {"a": "x", "c": "x"}):
        plan = plan_budgets(leaves, weights, None, domains)
        got = {}
        for _, _, source, _, _, _, budget in plan.nodes:
            if source:
                got[source] = got.get(source, 0) + budget
        total = sum(got.values())
        assert total == pytest.approx(510 / 0.5) and {s: b / total for s, b in got.items()} == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2})


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 8 + ["Big ", "B-ig".replace("-", ""), "mid_one", "Mid-One", "small", None, "unlisted"])
        text = rng.choice([None, "", *(["word " * rng.randint(1, 60)] * 12)])
        rows.append((2**60 + i, text, rng.choice(["en", "EN", "eng", "de_DE", "fr-FR", None, "??", "español"]), source))
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tokens", "h", "range", "repeats", "epochs", "rest")})


def weights(spark, *rows):
    return spark.createDataFrame(list(rows), WEIGHTS)


@pytest.mark.parametrize("bits,total", [(12, None), (2, None), (0, None), (12, 40_000.0), (12, 3_000.0)])
def test_shares_and_repeats(spark, monkeypatch, bits, total):
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    docs = corpus(spark)
    w = weights(spark, ("big", 0.5, 1), ("MID one", 0.3, 3), ("small", 0.15, 4), ("nobody", 0.05, 2), (None, 0.2, 1), ("unlisted", 0.0, 1))
    mix = mix_sources(docs, w, total=total)
    shares = {r["source"]: r for r in mix.shares.collect()}
    chosen = mix.documents.collect()
    assert set(shares) == {"big", "mid_one", "small", "nobody"} and {r["source"] for r in chosen} == {"big", "mid_one", "small"}
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    for s, r in shares.items():
        own = [c for c in chosen if c["source"] == s]
        assert r["documents"] == len(own) and r["tokens"] == sum(c["tokens"] * c["repeats"] for c in own) and r["most_repeats"] <= r["max_repeats"]
        assert all(1 <= c["repeats"] <= r["max_repeats"] for c in own)
        if own:
            assert max(c["repeats"] for c in own) - min(c["repeats"] for c in own) <= 1 or len({c["lang"] for c in own}) > 1
    whole = sum(r["tokens"] for r in shares.values())
    if total is None or total < 5000:  # every source can meet its share
        for s, share in (("big", 0.5), ("mid_one", 0.3), ("small", 0.15)):
            assert abs(shares[s]["actual_share"] - share / 0.95) < 0.05
    else:
        assert whole <= total and shares["big"]["most_repeats"] == 1
    assert sum(r["actual_share"] for r in shares.values()) == pytest.approx(1.0)
    assert {c["lang"] for c in chosen} <= {"en", "de", "fr", "und"}
    tree = mix.tree.collect()
    assert sum(r["tokens"] for r in tree if r["lang"] is None) == whole == sum(r["tokens"] for r in tree if r["source"])
    assert all(abs(r["tokens"] - r["budget"]) < 70 for r in tree if r["source"])
    again = {(r["doc_id"], r["repeats"]) for r in mix_sources(docs.repartition(7), w, total=total).documents.collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in chosen}
    other = {(r["doc_id"], r["repeats"]) for r in mix_sources(docs, w, seed=7, total=total).documents.collect()}
    assert other != again or total == 40_000.0


def test_edges(spark):
    docs = corpus(spark, 30)
    empty = mix_sources(docs.limit(0), weights(spark, ("big", 1.0, 1)))
    assert empty.documents.collect() == [] and [tuple(r) for r in empty.shares.collect()] == [("big", 1.0, 0.0, 0, 0, 1, 0)]
    none = mix_sources(docs, weights(spark))
    assert none.documents.collect() == [] and none.shares.collect() == []
    one = mix_sources(spark.createDataFrame([(1, "a b c", None, "x"), (1, "a b c", None, "x")], DOCS), weights(spark, ("x", 1.0, None)))
    assert [tuple(r) for r in one.documents.collect()] == [(1, "x", "und", 3, 1)] * 2
