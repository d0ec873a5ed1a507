import re

import numpy as np
import xxhash

from ledgerline.llm import common, simhash


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_roots(values):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    rng = np.random.default_rng(3)
    assert len(masks) == 31
    for n in (1, 2, 3, 4):
        for _ in range(500):
            flipped = sum(1 << int(b) for b in rng.choice(64, n, replace=False))
            assert any(flipped & m == 0 for m in masks)


def test_groups_equal_brute_force(few_docs):
    rows = simhash.near_groups(few_docs).collect()
    texts = {r.doc_id: r.text for r in few_docs.collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in rows} == prints
    roots = slow_roots(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert {r.doc_id: r.component_id for r in rows} == {i: least[roots[p]] for i, p in prints.items()}


def test_crowded_buckets_give_the_same_links(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    values = {base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 6), replace=False)) for _ in range(60)} | {int(x) for x in rng.integers(0, 2**62, 40)}
    roots = slow_roots(values)
    for in_task in (20_000, 3):
        edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp bigint"), in_task=in_task)
        linked = {r.node: r.root for r in simhash.components(edges).collect()}
        assert {v: linked.get(v, v) for v in values} == roots


def test_odd_rows(odd_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {3}
    kept = simhash.keep_one(odd_docs).collect()
    assert kept and len(kept) < len(rows) and set(odd_docs.columns) == set(simhash.keep_one(odd_docs).columns)
    assert sum(r.doc_id == 2 for r in kept) <= 1


def test_no_rows(odd_docs):
    assert simhash.near_groups(odd_docs.limit(0)).count() == 0


def test_no_side_as_large_as_the_corpus_is_broadcast(spark, monkeypatch):
    """Small tables are where Spark would; its size of the 31 masked rows of a fingerprint is that of one."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (simhash, common):
        monkeypatch.setattr(module, "materialise", lambda df, name, real=common.materialise: plans.append(plan(df)) or real(df, name))
    docs = spark.createDataFrame([(i, f"a text of some words that is about the number {i // 2}") for i in range(40)], "doc_id bigint, text string")
    kept = simhash.keep_one(docs)
    plans.append(plan(kept))
    assert not any("BroadcastExchange" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and 0 < kept.count() <= 20
