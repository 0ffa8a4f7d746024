"""Near-duplicate embeddings against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwell.llm.common import table
from panelwell.llm.embedding_dedup import NearDedupSettings, Quantiser, embedding_duplicates

VEC = "vec_id long, label int, embedding array<float>, n_links long, node string, copies int"
SF = "/root/testdata/sf0.001"


def clusters(seed=2, width=16):
    draw = np.random.default_rng(seed)
    rows, i = [], 0
    for size in (1,) * 150 + (2,) * 30 + (3,) * 20 + (60, 90):
        centre = draw.standard_normal(width)
        label = int(draw.integers(0, 3))
        spread = draw.choice([0.02, 0.1, 0.14])
        for _ in range(size):
            rows.append((i, label if draw.random() < 0.95 else None, (centre + spread * draw.standard_normal(width)).astype(np.float32).tolist()))
            i += 1
    copies = [(i + k, rows[k % 7][1], rows[k % 7][2]) for k in range(40)]
    draw.shuffle(rows)
    return [*rows, *copies]


def brute(rows, cosine):
    def fine(r):
        return r[0] is not None and r[1] is not None and r[2] and all(v is not None and math.isfinite(v) for v in r[2]) and any(r[2])

    links = {}
    for i, a in enumerate(rows):
        links[i] = [] if not fine(a) else [
            j for j, b in enumerate(rows) if j != i and fine(b) and a[1] == b[1] and len(a[2]) == len(b[2])
            and np.dot(a[2], b[2]) / math.sqrt(np.dot(a[2], a[2]) * np.dot(b[2], b[2])) >= cosine
        ]
    out = []
    for i, a in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((a[0], len(links[i]), least, least == a[0]))
    return sorted(out, key=str)


def answer(spark, rows, settings=NearDedupSettings()):
    df = spark.createDataFrame([(i, g, v, 1, "x", 2) for i, g, v in rows], VEC)
    return sorted((tuple(r) for r in embedding_duplicates(df, settings).collect()), key=str)


@pytest.mark.parametrize("settings", [
    NearDedupSettings(recall=1 - 1e-12),
    NearDedupSettings(recall=1 - 1e-12, block=20, bucket=16),  # large buckets meet block by block
])
def test_duplicates_equal_all_pairs(spark, settings):
    rows = clusters()
    assert answer(spark, rows, settings) == brute(rows, settings.cosine)


def test_recall_and_precision_of_the_default(spark):
    rows = clusters(4, 64)
    expected, found = brute(rows, 0.98), answer(spark, rows, NearDedupSettings(bucket=4))
    assert sum(r[1] for r in found) >= 0.95 * sum(r[1] for r in expected) > 1000
    assert all(f[1] <= e[1] for f, e in zip(found, expected))
    assert sum(f == e for f, e in zip(found, expected)) >= 0.9 * len(rows)


def test_awkward_vectors(spark):
    one, two = [1.0, 2.0], [2.0, 4.1]
    rows = [(1, 0, one), (2, 0, two), (3, 1, one), (4, None, one), (None, 0, one), (6, 0, None), (7, 0, []), (8, 0, [0.0, 0.0]),
            (9, 0, [float("nan"), 1.0]), (10, 0, [float("inf"), 1.0]), (11, 0, [None, 1.0]), (12, 0, [1.0, 2.0, 0.0]), (1, 0, one), (1, 0, [-1.0, 0.0]), (13, 1, [3.0, 6.0])]
    settings = NearDedupSettings(recall=1 - 1e-12)
    assert answer(spark, rows, settings) == brute(rows, 0.98)
    assert answer(spark, []) == []
    assert answer(spark, [(5, None, None), (5, None, None)]) == [(5, 0, 5, True)] * 2


def test_codes_are_balanced():
    draw = np.random.default_rng(1)
    points = draw.standard_normal((4000, 32)) * np.linspace(0.1, 3, 32) + 1
    points[:1500] = points[0] + 0.001 * draw.standard_normal((1500, 32))
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    settings = NearDedupSettings()
    codes = Quantiser.fit(unit, 8, 6, settings).codes(unit[1500:])
    assert codes.shape == (2500, 6)
    share = [(codes >> b & 1).mean() for b in range(8)]
    assert max(abs(s - 0.5) for s in share) < 0.08


def test_duplicates_of_the_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    found = sorted((tuple(r) for r in embedding_duplicates(table(spark, SF, "embeddings")).collect()), key=str)
    expected = brute(rows, 0.98)
    assert len(found) == len(rows) and sum(r[1] for r in found) >= 0.95 * sum(r[1] for r in expected)
    assert table(spark, SF, "embeddings").where(F.col("vec_id").isNull()).count() == 0
