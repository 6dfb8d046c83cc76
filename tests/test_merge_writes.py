"""A round of the linkage writes few tables, and the sizes carried along are those of the clusters."""

import numpy as np

from statewise.operators import clustering


def test_rounds_write_few_tables_and_carry_sizes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(f)) for i in range(40) for f in rng.choice(8, int(rng.integers(2, 5)), replace=False)]
    writes, write = [], clustering.staged
    monkeypatch.setattr(clustering, "staged", lambda df: writes.append(1) or write(df))
    items, merges = clustering.linkage_merges(spark.createDataFrame(rows, "pattern_id long, feature long"), 0.3)
    found = sorted(map(tuple, merges.select("round", "old", "new", "size").collect()))
    assert len(writes) <= 2 + 5 * (found[-1][0] + 2)
    size = {r["item"]: r["n"] for r in items.collect()}
    assert len(size) < 40
    for _, old, new, both in found:
        size[new] += size.pop(old)
        assert size[new] == both
