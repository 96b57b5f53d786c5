"""Hard negatives against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow import session
from furrow.llm import common, hard_negatives

DDL = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    common.configure(spark)


def relabel(i, label):
    return F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)


def plain(rows, every=50):
    usable = set()
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v) if max(map(abs, v)) < 1e300 else (1 << 60,)
        if sum(x * x for x in q) <= 1 << 53:
            usable.add((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for i, label, q in usable:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(q, r)), j, own) for j, own, r in usable
                  if j != i and len(r) == len(q)]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:5]:
            fits = sorted(x for x in others if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fits)]
    return sorted(out)


def ours(df, **kwargs):
    return sorted(tuple(r) for r in hard_negatives.mine(df, relabel=relabel, **kwargs).collect())


def clustered(seed, n, dim, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim)) + 1
    own = rng.integers(0, labels, n)
    x = centres[own] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.6, 2], (n, 1))
    return [(int(i), v.tolist(), int(label)) for i, v, label in zip(rng.permutation(n) + 1, x, own)]


@pytest.mark.parametrize("seed, n, dim", [(1, 400, 8), (2, 300, 64), (3, 300, 2), (4, 200, 1)])
def test_matches_plain(spark, monkeypatch, seed, n, dim):
    monkeypatch.setattr(hard_negatives, "BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "HELD", 4)
    rows = clustered(seed, n, dim)
    found = ours(spark.createDataFrame(rows, DDL).repartition(6), every=10)
    assert found == plain(rows, every=10)
    assert found


def test_hot_label_and_copies(spark):
    rows = [(i, [0.5, 0.25, -0.125], 1) for i in range(1, 700)] + clustered(5, 150, 3)
    rows = [(10_000 + k if k > 698 else i, v, label) for k, (i, v, label) in enumerate(rows)]
    assert ours(spark.createDataFrame(rows, DDL)) == plain(rows)


def test_odd_rows(spark):
    good = clustered(6, 120, 3)
    odd = [(50, None, 1), (100, [], 2), (150, [1.0, None, 2.0], 1), (200, [NAN, 1.0, 1.0], 1),
           (250, [INF, 0.0, 0.0], 1), (300, [0.0, 0.0, 0.0], 2), (350, [1.0, 1.0], 3), (351, [1.0, 0.9], 3),
           (352, [0.7, 0.7], 1), (400, [1e305, 0.0, 0.0], 1), (450, [1e9, 0.0, 0.0], 1), (None, [1.0, 2.0, 3.0], 1),
           (500, [1.0, 1.0, 1.0], None), (550, [1.0, 2.0, 1.0], 1), (550, [1.0, 2.0, 1.0], 1),
           (550, [1.0, 2.0, 1.5], 2), (0, [-0.0, 1e-9, -1e-9], 0), (-50, [1.0, 1.0, 1.0], 0),
           (-49, [1.5, 1.0, 1.0], -3), (600, [-1.0, -1.0, -1.0], 2), (601, [1.0, 1.0, 1.0], 2)]
    rows = good + odd
    assert ours(spark.createDataFrame(rows, DDL)) == plain(rows)


def test_empty_and_clashing_columns(spark):
    assert ours(spark.createDataFrame([], DDL)) == []
    rows = clustered(7, 150, 4)
    more = spark.createDataFrame(rows, DDL).withColumns(
        {c: F.lit("x") for c in ("dim", "q", "angle", "block", "a.b", "v", "score1", "anchor")})
    assert ours(more, every=10) == plain(rows, every=10)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 3, 16, 64]), st.sampled_from([1.0, 300.0, 1e5]))
def test_bounds_hold_every_product(seed, dim, size):
    rng = np.random.default_rng(seed)
    a, b = (np.floor(size * rng.standard_normal((9, dim))) for _ in range(2))
    b[0], b[1], b[2] = a[0], -a[1], 0
    s, t = (hard_negatives.angles_of(x).astype(np.float32) for x in (a, b))
    low, high = hard_negatives.bounds(s, t, np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    assert (low <= a @ b.T).all()
    assert (a @ b.T <= high).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 8, 64]))
def test_reach_of_a_block_holds_every_product(seed, dim):
    rng = np.random.default_rng(seed)
    def block(centre):
        q = np.floor(200 * (centre + 0.3 * rng.standard_normal((7, dim))))
        angles = hard_negatives.angles_of(q).astype("<f4")
        rows = [{"vec_id": i, "square": int(x @ x), "q": x.astype("<i4").tobytes(), "angles": y.tobytes()}
                for i, (x, y) in enumerate(zip(q, angles))]
        return hard_negatives.Block(hard_negatives._packed(rows, (dim, 0), 0))
    a, b = block(rng.standard_normal(dim)), block(rng.standard_normal(dim))
    assert (a.reach(b) >= (a.q @ b.q.T).max(axis=1)).all()


def packed(rows, dim, label, block, size, **extra):
    """Blocks as they come to a task; `extra`: a column of longs by id."""
    out = []
    for first in range(0, len(rows), size):
        part = sorted(rows[first:first + size])
        kept = [{"vec_id": i, "square": sum(x * x for x in q), "q": np.array(q, "<i4").tobytes(),
                 "angles": hard_negatives.angles_of(np.array([q], float)).astype("<f4").tobytes()} for i, q in part]
        row = hard_negatives._packed(kept, (dim, label), block + first)
        out.append(row | {n: np.array([f[i] for i, _ in part], "<i8").tobytes() for n, f in extra.items()})
    return out


@pytest.mark.parametrize("size", [40, 1500, 40_000])
@pytest.mark.parametrize("settings_", [{}, {"DENSE": 0.0, "ASIDE": 5}, {"DENSE": 9.0, "ASIDE": 0}, {"LONG": 0},
                                       {"ANCHOR_BLOCK": 7, "SINGLE": 1 << 20}])
@pytest.mark.parametrize("same", [True, False])
def test_held_anchors_keep_the_best_of_each_window(monkeypatch, size, settings_, same):
    for name, value in settings_.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(size)
    dim, k = 6, 3
    centre = rng.standard_normal(dim)
    draw = lambda i: (int(i), tuple(int(x) for x in np.floor(size * (centre + rng.standard_normal(dim)))))
    anchors, vectors = [draw(i) for i in range(60)], [draw(i) for i in range(20, 420)]
    vectors += [(i + 1000, q) for i, q in vectors[:90]] + [(i + 2000, (0,) * dim) for i in range(9)]
    vectors = [vectors[i] for i in rng.permutation(len(vectors))]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    windows = {i: [(0, s), (s // 2, s), (s, s), (1 << 60, -(1 << 60)), (-(1 << 60), 1 << 60)]
               for i, q in anchors for s in [sorted(score(q, v) for _, v in vectors)[-5]]}
    limits = {f"{n}{p}": {i: w[p][j] for i, w in windows.items()} for p in range(5) for j, n in enumerate(("low", "high"))}

    def of(row):
        return tuple(np.stack([np.frombuffer(row[f"{n}{p}"], "<i8") for p in range(5)], axis=1).astype(float)
                     for n in ("low", "high"))

    own = {i: i // 15 for i, _ in anchors}
    held = hard_negatives.Held([row for o in (2, 0, 3, 1) for row in packed(
        [x for x in anchors if own[x[0]] == o], dim, o, 100 * o, 9, **limits, anchor={i: i for i, _ in anchors})], of, k)
    for o in (4, 1, 0, 3, 2):
        for row in packed([x for n, x in enumerate(vectors) if n % 5 == o], dim, o, 0, 30):
            held.meet(hard_negatives.Block(row), o, same, np.empty(3000, np.float32))
    found = {}
    for row in held.out():
        names = np.frombuffer(row["anchor"], "<i8")
        for key, s, who in zip(*(np.frombuffer(row[c], kind).tolist() for c, kind in
                                 (("key", "<i4"), ("score", "<i8"), ("who", "<i8")))):
            found.setdefault((int(names[key // 5]), key % 5), []).append((-s, who))
    expected = {}
    for i, q in anchors:
        scores = sorted((-score(q, v), j) for n, (j, v) in enumerate(vectors) if j != i and (n % 5 == own[i]) == same)
        for p, (low, high) in enumerate(windows[i]):
            if best := [x for x in scores if low <= -x[0] <= high][:k]:
                expected[i, p] = best
    assert {key: sorted(x) for key, x in found.items()} == expected


def test_scores_beyond_single_floats(spark):
    rows = clustered(8, 200, 5)
    for scale in (2e4, 1e6):
        found = ours(spark.createDataFrame([(i, [x * scale / 256 for x in v], label) for i, v, label in rows], DDL), every=10)
        assert found == plain([(i, [x * scale / 256 for x in v], label) for i, v, label in rows], every=10)
        assert found


def test_vectors_of_different_width_in_one_block(spark):
    rows = [(i, [x * (300 if i % 3 else 1) for x in v], label) for i, v, label in clustered(9, 150, 4)]
    rows += [(400, [1.0, 2.0], 1), (400, [500.0], 1), (401, [1.0], 1), (402, [1.0, 1.9], 2)]
    assert ours(spark.createDataFrame(rows + rows[:40], DDL), every=10) == plain(rows, every=10)


def test_blocks_go_to_python_once_a_place(spark, capsys):
    """No join makes a row of every two blocks: anchors are held while the blocks pass by."""
    rows = clustered(10, 300, 4)
    blocks = hard_negatives.blocked(hard_negatives.usable(spark.createDataFrame(rows, DDL), 256.0, relabel), 20)
    at_home = hard_negatives.first_bounds(blocks, 10, 5)
    anchors = hard_negatives.blocked(at_home, 5, "floor long, anchor long")
    hard_negatives.positives(anchors, blocks, 5).explain()
    assert "Join" not in capsys.readouterr().out


def test_grid_keeps_copies_small(spark):
    """Rows by what a task can hold, at most some 64 copies of the anchors."""
    def frame(n, dim=64):
        return spark.createDataFrame([(n // 1000, dim)] * 1000, "n int, dim int")

    for n, partitions in ((10_000, 12), (600_000, 25), (15_000_000, 600), (75_000_000, 3000)):
        with session.settings(spark, {"spark.sql.shuffle.partitions": str(partitions)}):
            rows, columns = hard_negatives.grid(frame(n // 50), frame(n))
        assert rows == max(1, math.ceil(n / 50 / hard_negatives.HELD))
        assert min(2 * partitions, 34) <= columns <= max(64, n * 256 // (128 << 20) + 1)
    assert hard_negatives.grid(frame(100_000, 1536), frame(5_000_000, 1536))[0] >= 9
    with session.settings(spark, {"spark.sql.shuffle.partitions": "600"}):
        rows, columns = hard_negatives.grid(frame(1_000_000), frame(1_000_000))
    assert rows * columns >= 64 and rows + columns < 80
    assert hard_negatives.grid(frame(0), frame(0)) >= (1, 1)


def test_many_labels(spark):
    rows = [(i, v, i % 120) for i, v, _ in clustered(11, 600, 4)]
    found = ours(spark.createDataFrame(rows, DDL), every=5)
    assert found == plain(rows, every=5)
    assert found
