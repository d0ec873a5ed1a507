import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import queries, treap

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top=50):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    documents, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in counts:
            m = 100 - 50 + (50 * c.total() * documents) // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, k + 1, doc_id, -s) for k, (s, _, _, doc_id) in enumerate(sorted(scored)[:top])]
    return sorted(rows, key=str)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def rows_of(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def test_terms():
    text = "Ab-c_9é\x7fZZ x 中文\x00q'Q"
    assert [t.decode() for t in treap.terms(text)] == words(text) == ["ab", "c", "9é", "zz x", "中文", "q", "q"]


@pytest.mark.parametrize("seed", range(6))
def test_treap_holds_the_grid(seed):
    rng = np.random.default_rng(seed)
    shape = [(1, 1), (5, 900), (700, 3), (64, 64), (33, 500), (200, 200)][seed]
    grid = np.where(rng.random(shape) < 0.15, rng.integers(1, 1_000_000, shape), 0)
    grid[rng.integers(shape[0]), rng.integers(shape[1])] = 7
    rows, columns = np.nonzero(grid)
    shuffled = rng.permutation(len(rows))
    made = treap.load(treap.build(rows[shuffled], columns[shuffled], grid[rows, columns][shuffled]))
    assert made.maxima[0][0] == grid.max() and len(made.maxima[-1]) == np.count_nonzero(grid)
    ids = np.arange(shape[1]) * 3
    for _ in range(30):
        asked = np.unique(rng.integers(0, shape[0], rng.integers(1, 12)))
        weights = rng.integers(0, 50, len(asked))
        best = []
        treap.search(made, asked, weights, ids, best, 10)
        scores = weights @ grid[asked]
        wanted = sorted(((int(s), -int(ids[c])) for c, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == wanted


def test_bounds_hold_back_most_cells(monkeypatch):
    """Best-first order leaves ranges unopened when a few documents stand out."""
    rng = np.random.default_rng(3)
    grid = rng.integers(1, 100, (16, 4_096))
    grid[:, 500:520] = 1_000_000
    rows, columns = np.nonzero(grid)
    made = treap.load(treap.build(rows, columns, grid[rows, columns]))
    opened = []
    monkeypatch.setattr(treap, "_ONES", CountingTable(treap._ONES, opened))
    best = []
    treap.search(made, np.arange(16), np.ones(16, dtype=np.int64), np.arange(4_096), best, 20)
    assert {-p for _, p in best} == set(range(500, 520)) and sum(opened) < 16 * 4_096 / 4


class CountingTable:
    def __init__(self, table, opened):
        self.table, self.opened = table, opened

    def __getitem__(self, at):
        self.opened.append(at.size)
        return self.table[at]


def test_ranked(spark, few_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = rows_of(treap.ranked(few_docs, items))
    assert found == brute(pairs(few_docs, "doc_id"), pairs(items, "item_id"))
    assert found == rows_of(treap.ranked(few_docs.repartition(7), items))


def test_many_blocks_and_item_parts(spark, few_docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    monkeypatch.setattr(treap, "ITEMS_AT_ONCE", 7)
    monkeypatch.setattr(treap, "COLUMNS", 13)
    assert rows_of(treap.ranked(few_docs, items, 5)) == brute(pairs(few_docs, "doc_id"), pairs(items, "item_id"), 5)


def test_ties_and_odd_rows(spark, odd_docs):
    copies = spark.createDataFrame([(i % 70, "alpha beta") for i in range(200)] + [(500 + i, "gamma") for i in range(9)], "doc_id bigint, text string")
    items = spark.createDataFrame(
        [(1, "Alpha!", "x"), (2, "", "x"), (3, None, "x"), (None, "gamma beta", "x"), (4, "nowhere", "x"), (1, "Alpha!", "x"), (5, "the fox word idiot xxx call", "x")],
        "item_id bigint, text string, rank string")
    for docs in (copies, odd_docs):
        found = rows_of(treap.ranked(docs, items))
        assert found == brute(pairs(docs, "doc_id"), pairs(items, "item_id")) and found
    assert treap.ranked(copies.limit(0), items).count() == 0
    assert treap.ranked(copies, items.limit(0)).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(queries.SQL["op12_ranked_search"])
    df = queries.QUERIES["op12_ranked_search"](spark, folder)
    assert [c[0] for c in cursor.description] == df.columns and dict(df.dtypes)["rank"] == "int"
    wanted = defaultdict(int)
    for r in cursor.fetchall():
        wanted[r] += 1
    for r in df.collect():
        wanted[tuple(r)] -= 1
    assert wanted and not any(wanted.values())
