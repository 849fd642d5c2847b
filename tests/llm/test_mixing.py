"""Mixing against its definition."""

import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import SF_DIR

from spendguard.llm.mixing import fill_budget, mix, source_targets


def test_targets_reshare_the_excess():
    sizes = pd.DataFrame({"source": ["b", None, "a", "Z"], "source_size": [100, 1000, 10, 1000]})
    out = source_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert list(out["source"].fillna("-")) == ["Z", "a", "b", "-"]
    # Z weighs 3, a 1, b 2, null 3: a and b stop at twice their size, the rest is shared evenly.
    assert list(out["target"]) == pytest.approx([1472.5, 20, 200, 1472.5])


def test_budgets_are_met_where_a_subset_does():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 40), rng.integers(1, 6), replace=False)
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = fill_budget(lengths, counts, budget)
        sums = {int(np.dot(lengths, t)) for t in itertools.product(*[range(c + 1) for c in counts])}
        best = max(s for s in sums if s <= budget)
        assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= budget
        assert budget - (lengths * take).sum() <= max(budget - best, lengths.max())


def test_mix(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    one, two = (mix(docs).orderBy("doc_id").toPandas() for _ in range(2))
    assert one.equals(two) and (one.taken <= 2 * one["size"]).all()
    sums = one.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source")
    longest = sums["size"].max()
    assert ((sums.taken.sum() - sums.target.first()).abs() <= longest).all()
    assert sums.target.first().sum() == pytest.approx(1.5 * one["size"].sum())


def test_odd_rows(odd_docs, no_docs):
    out = mix(odd_docs).toPandas()
    assert len(out) == odd_docs.count() and (out.taken <= 2 * out["size"]).all()
    assert (out[out.doc_id.isin([2, 3, 4])]["size"] == 0).all()
    assert mix(no_docs).count() == 0
