import numpy as np
import pytest

from palaver.llm import mixing

from .helpers import ODD, docs, prose

WEIGHTS = (3.0, 1.0, 2.0)


def table(spark):
    rows = [(i, prose(20 + 7 * i % 300, i), "en", f"src{i % 5}" if i % 9 else None) for i in range(300)]
    rows += [(1000 + i, prose(50, i), "en", "tiny") for i in range(2)]
    return docs(spark, rows + rows[:3] + ODD)


def levels(sizes, share=1.5, most=2):
    """Targets by the rule's own words: hand out, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full, rest = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while rest > 1e-9:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in open_:
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                full.add(s)
    return target


def test_targets_and_taken(spark):
    df = table(spark)
    got = mixing.mix(df, block=8, shard_rows=40)
    rows = got.collect()
    assert len(rows) == df.count()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = levels(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    shards = {s: sum(r.source == s for r in rows) // 20 + 2 for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 8 * shards[s] for s in sizes)
    again = mixing.mix(df.repartition(7), block=8, shard_rows=40).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, got.select("doc_id", "size", "taken").collect()))


def test_mixed_documents_have_the_taken_words(spark):
    df = table(spark)
    planned = {}
    for r in mixing.mix(df).collect():
        planned[r.doc_id] = planned.get(r.doc_id, 0) + r.taken
    mixed = {}
    out = mixing.apply(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in out.collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert mixed == {k: v for k, v in planned.items() if v}


def test_quotas_are_highest_quotients(spark):
    rng = np.random.default_rng(4)
    for seats in (1, 7, 100, 1000):
        weight = [float(x) for x in rng.integers(1, 1000, 30)] + [5.0, 5.0, 5.0]
        rows = spark.createDataFrame([(i, w, 10**6) for i, w in enumerate(weight)], "rank int, weight double, cap long")
        got = {r["rank"]: r["quota"] for r in mixing.quotas(rows, "weight", seats, "cap", "rank").collect()}
        want = [0] * len(weight)
        for _ in range(seats):
            i = max(range(len(weight)), key=lambda i: (weight[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert [got[i] for i in range(len(weight))] == want


def test_empty_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    only = mixing.mix(docs(spark, ODD[1:3])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
    assert mixing.apply(docs(spark, [])).count() == 0
