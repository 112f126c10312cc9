"""The corpus queries run over whole tables, and agree with plain Python."""

import duckdb
import pytest

from tablelens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    enough = DATA.replace("sf0.001", "sf0.01")  # the smallest tables hold too few labels to learn from
    assert queries.QUERIES[name](spark, enough if name.startswith("p8") else DATA).count() > 0


def test_every_document_is_encoded(spark):
    got = [(r["doc_id"], len(r["ids"])) for r in queries.p6_ids(spark, DATA).collect()]
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert sorted(i for i, _ in got) == sorted(i for i, _ in rows)
    assert {i for i, n in got if n == 0} == {i for i, t in rows if not t}


def test_shares_are_near_their_targets(spark):
    shares = queries.p7_shares(spark, "/root/testdata/sf0.1").collect()
    there = [r for r in shares if r["documents"]]
    total = sum(r["target_share"] for r in there)
    assert len(shares) == 8 and all(abs(r["actual_share"] - r["target_share"] / total) < 0.01 for r in there)
    assert all(r["most_repeats"] <= r["max_repeats"] for r in shares)


def test_shortages_are_passed_on(spark):
    tree = queries.p7_short_tree(spark, "/root/testdata/sf0.1").collect()
    for level in (lambda r: r["source"], lambda r: r["lang"] and not r["source"], lambda r: not r["lang"]):
        own = [r for r in tree if level(r)]
        assert any(r["budget"] < r["wanted"] - 1 for r in own) and any(r["budget"] > r["wanted"] + 1 for r in own)
    assert all(abs(r["tokens"] - r["budget"]) < 20_000 for r in tree)
