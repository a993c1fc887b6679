"""Cap filters: recall at several sizes, the bound of rounded vectors, and whole results against brute force."""

import math

import numpy as np
import pytest

from changeledger.llm import caps
from changeledger.llm.caps import Codes, near_vectors
from changeledger.llm.queries import op4_cap_filters


def units(random, n, d):
    x = random.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beside(random, u, cosine):
    w = random.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return cosine * u + np.sqrt(1 - cosine ** 2) * w


@pytest.mark.parametrize("dimension", [64, 384])
@pytest.mark.parametrize("n", [2_000, 20_000, 200_000, 2_000_000])
def test_few_pairs_share_no_filter(n, dimension):
    random = np.random.default_rng(n + 1)
    codes = Codes.fitted(dimension, n, 0.95)
    u = units(random, 3_000, dimension)
    assert codes.missed(u, beside(random, u, 0.951)) < 0.01
    assert codes.missed(u, beside(random, u, 0.98)) < 0.002
    assert len(codes.decode(u)[0]) / len(u) < 100


@pytest.mark.parametrize("dimension", [1, 2, 3, 5])
def test_small_dimensions(dimension):
    random = np.random.default_rng(3)
    codes, u = Codes.fitted(dimension, 1_000, 0.95), units(random, 200, dimension)
    assert codes.missed(u, u) == 0


def test_rounding_keeps_links():
    random = np.random.default_rng(1)
    u = units(random, 400, 64)
    v = beside(random, u, 0.9501)
    (a, sa, ea), (b, sb, eb) = caps._rounded(u), caps._rounded(v)
    about = ((a * sa[:, None]) * (b * sb[:, None])).sum(1)
    assert (about >= 0.95 - ea - (1 + ea) * eb).all() and ea.max() < 0.02


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of (id, vector or None)."""
    usable = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for dimension in {len(rows[i][1]) for i in usable}:
        of = [i for i in usable if len(rows[i][1]) == dimension]
        x = np.array([rows[i][1] for i in of])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[of[a]].add(of[b])
    smallest = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in smallest:
                smallest[j] = rows[i][0]
                todo += links[j]
    return sorted(((rows[i][0], len(links[i]), smallest[i], rows[i][0] == smallest[i]) for i in range(len(rows))), key=repr)


def groups_of_vectors(seed, n, d):
    """Random vectors, near ones just above and below the bound, a chain, a large group of near copies, equal vectors."""
    random = np.random.default_rng(seed)
    u = units(random, n, d)
    x = [*u, *beside(random, u[:n // 4], 0.9505), *beside(random, u[:n // 4], 0.9495), *(u[:5] * 3), *u[:5]]
    chain = u[7]
    for _ in range(12):
        chain = beside(random, chain[None], 0.96)[0]
        x.append(chain)
    hot = u[8]
    x += [*beside(random, np.repeat(hot[None], n // 3, 0), 0.985)]
    return [v.tolist() for v in x]


@pytest.mark.parametrize("block", [1_024, 50])
def test_whole_results(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    vectors = groups_of_vectors(4, 400, 64) + groups_of_vectors(5, 60, 7)
    vectors += [None, [], [0.0] * 64, [math.nan] * 64, [math.inf] + [0.0] * 63, [None] + [1.0] * 63, [-0.0] * 63 + [1e-300], [0.0] * 63 + [1e300]]
    rows = list(enumerate(vectors)) + [(3, vectors[3]), (None, vectors[4])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in near_vectors(frame).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    linked = sum(r[1] for r in want)
    found = sum(r[1] for r in got)
    assert 0.995 * linked <= found <= linked
    by_id = {r[0]: r for r in want}
    assert all(r[1] <= by_id[r[0]][1] for r in got if r[0] not in (3, None))
    assert sum(tuple(r[:3]) != by_id[r[0]][:3] for r in got) <= 0.01 * len(got)


def test_recall_of_twenty_thousand(spark):
    """Every vector whose number is divisible by 20 against all."""
    random = np.random.default_rng(8)
    u = units(random, 10_000, 64)
    x = np.concatenate([u, beside(random, u, 0.9505)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {r.vec_id: r.n_links for r in near_vectors(frame).collect()}
    asked = np.arange(0, len(x), 20)
    want = (x[asked] @ x.T >= 0.95).sum(1) - 1
    got = np.array([found[i] for i in asked])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() >= 1_000


def test_query(spark, tmp_path):
    rows = [(i, v, "x") for i, v in enumerate(groups_of_vectors(6, 90, 16))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    result = op4_cap_filters(spark, str(tmp_path))
    assert dict(result.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert result.count() == len(rows)
