"""Scores of n-grams where hashes could meet: more documents than the smallest tables have, and the packing of hashes."""

import numpy as np
import pytest
from conftest import SMALL

from passagemill.llm import lm, queries


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_steps_of_hashes_round_trip(n):
    dice = np.random.default_rng(n)
    for high in (2**64 - 1, 2**40, 4 * n):
        names = np.unique(dice.integers(0, high, n, dtype=np.uint64, endpoint=True))
        assert (lm._names(lm._steps(names)) == names).all()
    uneven = np.unique(np.concatenate([np.arange(n, dtype=np.uint64), np.array([2**63, 2**64 - 1], np.uint64)]))
    assert (lm._names(lm._steps(uneven)) == uneven).all()


def test_steps_take_few_bits_beyond_the_least():
    names = np.unique(np.random.default_rng(0).integers(0, 2**63, 60_000, dtype=np.uint64))
    least = 63 - np.log2(len(names)) + np.log2(np.e)
    assert 8 * len(lm._steps(names)) / len(names) < least + 0.7


def test_scores_of_the_larger_tables(spark, same):
    import duckdb

    folder = SMALL.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    same(queries.QUERIES["op1_lm_scoring"](spark, folder), con.sql(lm.OP1_SQL))
