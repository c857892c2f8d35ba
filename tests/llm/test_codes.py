"""Grid codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallygrove.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    least = {}
    for i, v, _ in kept:
        least[i] = min(v, least.get(i, v))
    first = [least[i] for i in sorted(least, key=lambda i: (i is None, i or 0))[:entries]]
    w = len(first[0]) // parts
    books = [[v[k * w : (k + 1) * w] for v in first] for k in range(parts)]

    def assign(k, v):
        part = v[k * w : (k + 1) * w]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        moved = []
        for k in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(assign(k, v)[1], []).append(v[k * w : (k + 1) * w])
            moved.append([[sum(c) // len(c) for c in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[k])])
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, lab, [assign(k, v) for k in range(parts)]) for i, v, lab in kept]
    sums = {}
    for _, lab, f in found:
        sums[lab] = sums.get(lab, 0) + sum(d for d, _ in f)
    return [(i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), sums[lab], digest) for i, lab, f in found]


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("n, spread", [(400, 1.0), (300, 0.05), (3, 1.0)])
def test_codes_equal_brute_force(spark, n, spread):
    rng = random.Random(n)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    vec = lambda: [float(np.float32(c + spread * rng.gauss(0, 0.3))) for c in rng.choice(centres)]
    rows = [(i * 3 % 1009, vec(), rng.choice([0, 1, None])) for i in range(n)]
    rows += [(5000, None, 1), (5001, [0.1] * 7 + [None], 1), (5002, [0.1] * 7 + [float("nan")], 0), (5003, [float("inf")] + [0.1] * 7, 0), (None, vec(), None), rows[0], rows[0], (rows[1][0], vec(), 1), (9, [0.0] * 8, 2), (10, [0.0] * 8, 2)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=32).collect()
    assert order(got) == order(brute(rows, entries=32))


def test_codes_of_few_and_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.compress(empty).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(i, [i / 7, -i / 5, 0.25, float(i)], 1) for i in range(5)]
    wide = spark.createDataFrame([(*r, "x", "y", 3, "z", 1, 2, 3) for r in rows], SCHEMA + ", code string, v string, error int, id string, part int, entry int, at int")
    assert order(codes.compress(wide).collect()) == order(brute(rows))


def test_mixed_lengths_and_huge_components_are_refused(spark):
    for rows in ([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], [(1, [0.0] * 6, 1)]):
        with pytest.raises(ValueError, match="one length"):
            codes.compress(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA)).collect()


def test_cells_compare_fewer_entries_and_settle_each_cell_once():
    rng = np.random.default_rng(1)
    book = rng.integers(-600, 600, (256, 4))
    parts = rng.integers(-600, 600, (20_000, 4))
    grid = codes.Cells(book)
    index, error = grid.nearest(parts)
    again, _ = grid.nearest(parts[:100])
    far = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (error == far.min(1)).all() and (again == index[:100]).all()
    assert len(grid.lists) < 11**4 and grid.compared < 0.1 * grid.looked * len(book)
