from collections import Counter

from ledgerline.llm import mixing


def test_shares_stay_within_a_block(spark):
    rows = [(i, "abcde"[min(4, i % 9)]) for i in range(4_000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), {"a": 7, "b": 3, "c": 2}, block_rows=4).collect()
    assert len(out) == len(rows) and Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    weights, total = {"a": 7, "b": 3, "c": 2, "d": 1, "e": 1}, 14
    slots = {}
    for r in out:
        assert r.release_slot <= r.mix_slot < r.deadline_slot
        assert slots.setdefault(r.mix_slot, (r.source, r.block)) == (r.source, r.block)
    horizon, count = max(r.mix_slot for r in out if r.in_mix), Counter()
    for t in range(horizon + 1):
        count[slots[t][0]] += 1
        assert all(abs(count[s] - w * (t + 1) / total) < 1 for s, w in weights.items())
    assert horizon > 200


def test_odd_rows(odd_docs):
    out = mixing.in_order(mixing.mix(odd_docs, {"a": 2}, block_rows=2))
    assert out.count() == odd_docs.count()
    assert {r.source for r in out.collect()} == {"a", "b", "c", None}
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
