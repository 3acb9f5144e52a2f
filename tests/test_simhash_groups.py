import random

from millrace.operators import etl


def signatures():
    rnd = random.Random(11)
    own = [rnd.getrandbits(64) for _ in range(60)]
    for k in range(90):
        own.append(own[rnd.randrange(len(own))] ^ sum(1 << b for b in rnd.sample(range(64), k % 6)))
    rows = [(i, u - (1 << 64) if u >> 63 else u) for i, u in enumerate(own)]
    return [*rows, *((1000 + i, rows[i][1]) for i in range(0, 150, 7)), (2000, 0), (2001, -1)]


def slow(rows):
    """The least doc_id that links of at most three bits reach, over all pairs."""
    low = {i: i for i, _ in rows}
    while True:
        new = {i: min(low[j] for j, v in rows if ((u ^ v) & (2**64 - 1)).bit_count() <= 3) for i, u in rows}
        if new == low:
            return low
        low = new


def test_groups_without_a_broadcast_of_keys(spark, monkeypatch):
    rows, plans, components = signatures(), [], etl.connected_components

    def seen(pairs):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return components(pairs)

    monkeypatch.setattr(etl, "simhash64", lambda docs: docs)
    monkeypatch.setattr(etl, "connected_components", seen)
    out = etl.simhash_groups(spark.createDataFrame(rows, "doc_id bigint, fp bigint"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)
    got = out.collect()
    assert len(got) == len(rows) and {r.doc_id: r.group_id for r in got} == slow(rows)
    assert etl.simhash_groups(spark.createDataFrame([], "doc_id bigint, fp bigint")).count() == 0
