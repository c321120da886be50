"""Near-dedup of embeddings against all pairs; the traversal on its own; odd vectors."""

import numpy as np
import pytest

from siftline.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<double>, label int, set_id string, n int"


def plain(rows):
    """vec_id, n_links, component_id, kept by all pairs."""
    units = []
    for _, v, *_ in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= em.THRESHOLD] for i in range(n)]
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                fresh = set(near[todo.pop()]) - group
                group |= fresh
                todo += fresh
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return out


def got(spark, rows, unit=em.UNIT):
    df = spark.createDataFrame([(*r[:2], 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return list(map(tuple, em.near_dedup(df, unit).collect()))


def sort(rows):
    return sorted(rows, key=str)


def mixed(rng, n, dims=16):
    """Vectors without structure, groups at all distances about the threshold, tight groups, and a chain."""
    base = rng.normal(size=(n // 3, dims))
    loose = base[rng.integers(0, 6, n // 3)] + rng.normal(size=(n // 3, dims)) * rng.choice([0.05, 0.2, 0.33, 0.5], (n // 3, 1))
    tight = base[0] + rng.normal(size=(n // 3, dims)) * 0.01
    turn = np.linspace(0, 3, 40)
    chain = np.zeros((40, dims))
    chain[:, 0], chain[:, 1] = np.cos(turn), np.sin(turn)
    return np.concatenate([base, loose, tight, chain, base[:5], base[:5] * 3.5])


@pytest.mark.parametrize(("unit", "size"), [(em.UNIT, em.BYTES), (90, em.BYTES), (em.UNIT, 64 * 16 * 8)])
def test_equals_all_pairs(spark, monkeypatch, unit, size):
    monkeypatch.setattr(em, "BYTES", size)
    rng = np.random.default_rng(2)
    x = mixed(rng, 900)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) + 5, x, strict=True)]
    rows += [(5000 + i, x[0].tolist()) for i in range(300)]  # a very common vector
    assert sort(got(spark, rows, unit)) == sort(plain(rows))


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [1e300, 1e290]), (10, [1e-300, 0.0])]
    rows += [(11, [1.0, 0.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [-1.0, -1.0]), (None, [-1.0, -1.0]), (None, None)]
    assert sort(got(spark, rows)) == sort(plain(rows))
    assert got(spark, []) == [] and got(spark, [(3, None)]) == [(3, 0, 3, True)]


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("spread", [0.02, 0.12, 0.2, 0.35])
def test_walk_counts_every_link(alone, spread):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 24))

    def side(n):
        x = middles[rng.integers(0, 12, n)] + rng.normal(size=(n, 24)) * spread * np.linalg.norm(middles[0]) / 5
        x /= np.linalg.norm(x, axis=1)[:, None]
        paths = em.levels(x)
        order = np.lexsort(paths.T[::-1])
        return em.Side(x[order], paths[order], rng.integers(1, 4, n))

    left, right = side(500), None if alone else side(400)
    walk = em.Walk(left, right)
    other = left if alone else right
    links = left.x @ other.x.T >= em.THRESHOLD
    if alone:
        np.fill_diagonal(links, False)
        want = links @ left.copies
    else:
        want = np.concatenate([links @ right.copies, links.T @ left.copies])
    assert (walk.links == want).all()
    whole = links if alone else np.block([[np.zeros((500, 500), bool), links], [links.T, np.zeros((400, 400), bool)]])
    label = np.arange(len(whole))
    for _ in range(len(whole)):
        fresh = np.minimum(label, np.where(whole, label[None, :], len(whole)).min(axis=1))
        if (fresh == label).all():
            break
        label = fresh
    assert (walk.root == label).all()


def test_tight_groups_are_counted_without_comparing_their_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=32) + rng.normal(size=(4000, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    walk = em.Walk(em.Side(x, em.levels(x), np.ones(len(x), np.int64)), None)
    assert (walk.links == len(x) - 1).all() and walk.compared < 100


def test_levels_are_nested_nets():
    x = np.random.default_rng(5).normal(size=(600, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    paths = em.levels(x)
    for k, radius in enumerate(em.RADII):
        assert np.linalg.norm(x - x[paths[:, k]], axis=1).max() <= radius + 1e-7
        centres = np.unique(paths[:, k])
        assert (paths[centres, k:] == centres[:, None]).all()
