"""Packings in which every limit binds."""

import os

from tidemark.llm import queries

BASE = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


def test_loss_limit_binds(spark):
    r, plain = queries.p7_fill_loss(spark, BASE).first(), queries.p7_fill_tokens(spark, BASE).first()
    limits = queries.LESS_LOSS
    assert limits.loss < limits.tokens and r["most_loss"] <= limits.loss < plain["most_loss"]
    assert r["most_tokens"] <= limits.tokens and r["most_segments"] <= limits.segments and r["fewest"] <= r["containers"]
    assert r["containers"] >= plain["containers"]


def test_every_token_is_placed_once(spark):
    total = lambda df: tuple(df.selectExpr("sum(n_tokens)", "count(distinct doc_id, piece) = count(*)").first())
    got, plain = total(queries.p7_packed_loss(spark, BASE)), total(queries.p7_packed(spark, BASE))
    assert got == plain and got[1]
