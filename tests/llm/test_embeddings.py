from collections import Counter

import numpy as np

from ledgerline.llm import embeddings


def slow(rows):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], n[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def found(spark, rows, **params):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, key string")
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, **params).collect())


def made(seed, n=150, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dims))
    rows = [centres[rng.integers(len(centres))] + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.08, 0.2]) for _ in range(n)]
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(2)), "clash") for i, v in enumerate(rows)]


def test_links_equal_brute_force(spark):
    rows = made(1)
    mine, wanted = found(spark, rows), slow(rows)
    assert sum(r[1] for r in mine) >= 0.9 * sum(r[1] for r in wanted)
    assert sum((mine & wanted).values()) >= 0.9 * len(rows)
    assert found(spark, rows, tile=7) == mine


def test_large_group_in_tiles(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    rows = [(i, [float(np.float32(x)) for x in centre + 0.02 * rng.standard_normal(64)], 1, "") for i in range(120)] + [(500 + i, [float(np.float32(x)) for x in centre], 1, "") for i in range(30)]
    assert found(spark, rows, tile=16) == slow(rows)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1, ""), (2, [2.0, 0.0], 1, ""), (2, [2.0, 0.0], 1, ""), (3, [1.0, 0.0], 2, ""), (4, None, 1, ""), (5, [0.0, 0.0], 1, ""), (6, [1.0, None], 1, ""),
        (7, [float("nan"), 1.0], 1, ""), (8, [float("inf"), 1.0], 1, ""), (9, [1.0, 0.0], None, ""), (10, [1.0, 0.0, 0.0], 1, ""), (11, [], 1, ""), (None, None, None, None),
    ]
    mine = found(spark, rows)
    assert mine[(1, 2, 1, True)] == 1 and mine[(2, 2, 1, False)] == 2 and mine[(None, 0, None, True)] == 1
    assert all(mine[(i, 0, i, True)] == 1 for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert not found(spark, rows[:0])
