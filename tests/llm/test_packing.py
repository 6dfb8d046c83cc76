"""Groups that fill a shard exactly share it."""

from collections import Counter, defaultdict

import pytest

from statewise.llm import sharding


def test_large_groups_are_packed_by_their_exact_size(spark):
    rows = [(i, chr(97 + i) * 499_999) for i in range(4)]
    got = sharding.shard_groups(spark.createDataFrame(rows, "doc_id long, text string"), shards=None, capacity=1_000_000).collect()
    assert sorted(r["shard"] for r in got) == [0, 0, 1, 1] and {r["size"] for r in got} == {500_000}


def _one_by_one(sizes, capacity):
    left: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(max(capacity, size) - size)
    return sorted(max(capacity, 0) - room for room in left)


@pytest.mark.parametrize("capacity", [200, 1000, 5000])
def test_fixed_capacity_is_best_fit_one_by_one(spark, capacity):
    rows = [(i, "xyz"[i % 3] * (i * 37 % 150) + str(i // 4)) for i in range(400)] + [(1000, None), (1001, ""), (1001, "")]
    groups = Counter()
    for _, text in rows:
        groups[text] += len((text or "").encode()) + 1
    got = sharding.shard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=None, capacity=capacity).collect()
    loads, homes, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        homes[(r["size"], r["text_crc32"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(loads.values()) == _one_by_one(groups.values(), capacity) and max(loads.values()) <= capacity
    assert all(len(h) == 1 for key, h in homes.items() if key != (1, 0))  # null and empty text are two groups


def test_many_groups_of_one_size_and_a_hot_group(spark):
    """200 shards of 50 equal groups each, and a group of 3,000 rows that is cut into pieces of whole rows."""
    rows = [(i, f"{i:07d}") for i in range(10_000)] + [(20_000 + i, "same") for i in range(3_000)]
    got = sharding.shard_groups(spark.createDataFrame(rows, "doc_id long, text string"), shards=None, capacity=400).collect()
    loads, hot = Counter(), Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
        if r["group_rows"] == 3_000:
            hot[r["shard"]] += 1
    assert len(got) == len(rows) and max(loads.values()) == 400 and len(loads) == (10_000 * 8 + 3_000 * 5) // 400 + (1 if (10_000 * 8 + 3_000 * 5) % 400 else 0)
    assert max(hot.values()) == 80 and sum(hot.values()) == 3_000
