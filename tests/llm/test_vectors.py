import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm import vectors


def brute(rows, cosine=0.93):
    """All pairs, one by one."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for i, j in itertools.combinations(good, 2):
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                near[i].add(j)
                near[j].add(i)
    component = {}
    for i in range(len(rows)):
        if i not in component:
            seen, todo = {i}, [i]
            while todo:
                todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
            least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
            component |= dict.fromkeys(seen, least)
    return Counter((rows[k][0], len(near[k]), component[k], rows[k][0] == component[k]) for k in range(len(rows)))


def result(table, **options):
    return Counter(tuple(r) for r in vectors.linked_vectors(table, **options).collect())


def corpus(dims, n=240):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(n, dims))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    for noise in (0.02, 0.2, 0.35, 0.4, 0.45):  # cosines around 0.93
        rows += [(len(rows) + k, (base[k] + noise * rng.normal(size=dims)).tolist(), int(k % 3)) for k in range(40)]
    step = rng.normal(size=dims)
    rows += [(1000 + k, (base[0] + 0.08 * k * step).tolist(), 0) for k in range(30)]  # a chain
    return rows


@pytest.mark.parametrize(("dims", "kind"), [(3, "double"), (20, "float"), (64, "double")])
def test_links_match_brute_force(spark, dims, kind, monkeypatch):
    monkeypatch.setattr(vectors, "TILES", (16, 16))  # many tiles of a cell
    rows = corpus(dims)
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    rows = [tuple(r) for r in table.collect()]
    assert result(table) == brute(rows)


def test_each_pair_belongs_to_one_block():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    v = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0, 0.1, 0.3, 0.4)])
    found = Counter()
    for block in range(4):
        i, j = vectors.linked_pairs(v, v, True, block, 0.93)
        found.update(zip(i.tolist(), j.tolist(), strict=True))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    assert found == Counter(zip(i.tolist(), j.tolist(), strict=True))


def test_nulls_copies_and_other_dimensions(spark):
    rows = [
        (5, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (3, [2.0, 0.0], "a"), (9, [1.0, 0.01], "a"), (1, [1.0, 0.0], "b"), (2, [1.0, 0.0, 0.0], "a"), (4, [1.0, 0.0], None), (None, [1.0, 0.0], "c"), (None, [0.0, 1.0], "a"),
        (6, None, "a"), (7, [], "a"), (8, [0.0, 0.0], "a"), (10, [None, 1.0], "a"), (11, [float("nan"), 1.0], "a"), (12, [float("inf"), 1.0], "a"), (13, [1e300, 1e300], "d"), (14, [1e-300, 1e-300], "d"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    clashing = table.withColumns({c: F.lit("own") for c in ("node", "cells", "id", "v", "n_links", "kept")})
    want = brute(rows)
    assert result(clashing) == want and want[(5, 3, 3, False)] == 1 and want[(13, 1, 13, True)] == 1
    assert result(table.limit(0)) == Counter()
    assert result(table.where("vec_id = 8")) == Counter({(8, 0, 8, True): 1})
