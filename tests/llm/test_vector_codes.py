"""Codes against a full search, codebooks against plain means, and the memo's exactness."""

import hashlib

import numpy as np
import pytest

from factloom.llm import vector_codes as v


def brute(rows, parts, entries, rounds, scale=v.SCALE):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.clip(np.floor(scale * float(np.float32(x))), -v.LIMIT, v.LIMIT)) for x in r[1]] for r in kept]
    dims = -(-max(map(len, whole), default=0) // parts) * parts
    x = np.array([w + [0] * (dims - len(w)) for w in whole], np.int64).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    books = [[x[i, p].tolist() for i in order[:entries]] for p in range(parts)]

    def assign(p, book):
        d = [[sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in book] for row in x[:, p].tolist()]
        return [min((value, j) for j, value in enumerate(ds)) for ds in d]

    for p in range(parts):
        for _ in range(rounds):
            codes = [j for _, j in assign(p, books[p])]
            for j in range(len(books[p])):
                mine = [x[i, p] for i, c in enumerate(codes) if c == j]
                if mine:
                    books[p][j] = [int(sum(int(m[k]) for m in mine)) // len(mine) for k in range(x.shape[2])]
    found = [assign(p, books[p]) for p in range(parts)]
    code = ["".join(f"{found[p][i][1]:02x}" for p in range(parts)) for i in range(len(kept))]
    error = [sum(found[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return [(r[0], c, e, by_label[r[2]], sha, r[2]) for r, c, e in zip(kept, code, error, strict=True)]


def table(spark, rows):
    full = [(i, e, lab, 1, "x") for i, e, lab in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, code int, v string").repartition(3)


def same(spark, rows, **how):
    how = {"parts": 4, "entries": 5, "rounds": 3} | how
    got = v.compress(table(spark, rows), **how)
    want = brute(rows, how["parts"], how["entries"], how["rounds"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def some(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.normal(0, 0.1, dims).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(n)]


def test_codes_are_those_of_a_full_search(spark):
    rows = some(90, 8)
    rows += [rows[0], rows[1], (7, rows[2][1], 1), (None, rows[3][1], None), (None, rows[4][1], 2)]
    rows += [(200, None, 1), (201, [None] + [0.5] * 7, 1), (202, [float("nan")] + [0.5] * 7, 1), (203, [float("inf")] * 8, 9), (204, [1e30] * 8, 4), (205, [-0.0, 0.0] * 4, 4)]
    same(spark, rows)


def test_ties_fall_to_the_lower_entry(spark):
    same(spark, [(i, [0.25 * (i % 3 - 1)] * 8, 1) for i in range(40)])


def test_ragged_few_and_empty(spark):
    same(spark, [(i, e[: 8 - i % 3], lab) for i, e, lab in some(30, 8)])
    same(spark, some(3, 8))
    same(spark, [(1, [], 1), (2, [], 1)])
    for none in ([(1, None, 1)], []):
        assert v.compress(table(spark, none) if none else table(spark, some(1, 8)).limit(0)).count() == 0


def test_given_sizes(spark):
    same(spark, some(60, 64), parts=8, entries=16, rounds=6)


@pytest.mark.parametrize("side", [1, 40, 512, 5000])
def test_grid_equals_full_search(side, monkeypatch):
    rng = np.random.default_rng(side)
    book = rng.integers(-600, 600, (16, 8))
    book[9] = book[4]
    points = np.concatenate([rng.integers(-900, 900, (3000, 8)), book, np.repeat(book[:1] + 1, 50, 0)])
    full = ((points[:, None] - book) ** 2).sum(2)
    grid = v.Grid(book, side)
    for half in (points[:1500], points[1500:], points):
        code, best = grid.nearest(half)
        want = full[:1500] if half is points[:1500] else ((half[:, None] - book) ** 2).sum(2)
        assert (code == want.argmin(1)).all() and (best == want.min(1)).all()
    if side == 40:
        assert grid.evaluated < grid.searched
    # No memo at all, and a hash under which all cells meet, change nothing.
    for other in (v.Grid(book, side, memo_cells=0), v.Grid(book, side)):
        if other.memo_cells:
            monkeypatch.setattr(v, "mixed", lambda x: x * np.uint64(0))
        assert (other.nearest(points)[0] == full.argmin(1)).all()
        assert (other.nearest(points[::-1])[0] == full[::-1].argmin(1)).all()


def test_decoded_errors_are_the_distances(spark):
    rows = v.whole_vectors(table(spark, some(50, 8)), parts=4)
    books = v.train(rows, 4, 5, 2)
    out = v.decode(v.encode(rows, books), books).collect()
    given = {r.vec_id: r.v for r in rows.collect()}
    for r in out:
        assert r.error == sum((a - b) ** 2 for a, b in zip(given[r.vec_id], r.v, strict=True))
