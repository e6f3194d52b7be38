"""Clustering with bounds against plain rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from hopflux.llm import centroids
from hopflux.llm.queries import QUERIES


def plain(rows, k=8, rounds=10, dims=64):
    """(vec_id, vector) rows -> sorted (vec_id, cluster, squared distance), and the centroids."""
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in first]
    for number in range(rounds + 1):
        found = []
        for i, v in good:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in now]
            found.append((i, d.index(min(d)), min(d), v))
        if number < rounds:
            for c in range(len(now)):
                mine = [v for _, x, _, v in found if x == c]
                if mine:
                    now[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), c, min(d, 2**63 - 1)) for i, c, d, _ in found) if now else [], now


def got(spark, rows, dims=64, kind="float", **how):
    frame = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], f"vec_id long, embedding array<{kind}>, row long, v long, cluster long, moved long")
    found, now = centroids.cluster_vectors(frame, dims=dims, **how)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()), now


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    out = QUERIES["op13_centroid_clustering"](spark, folder).collect()
    want, now = plain(rows)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in out) == want
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    for r in out:
        assert r["centroid_sha256"] == named[r["cluster"]] and r["inertia"] == sum(d for _, _, d in want)
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


@pytest.mark.parametrize("seed", [1, 2])
def test_close_clusters_ties_and_copies(spark, seed):
    """Vectors on a coarse grid: many ties and copies, centroids that move for many rounds."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-4, 5) / 1024 + (i % 5) / 512 for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.0, 0.0, 0.0, 0.0]) for i in range(200)] + [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.25] * 4)]
    want, now = plain(rows, dims=4)
    assert got(spark, rows, dims=4, kind="double") == (want, now)


def test_rows_that_are_left_out(spark):
    good = [(i, [i / 7, -i / 3]) for i in range(12)]
    bad = [(50, None), (51, []), (52, [1.0]), (53, [1.0, 2.0, 3.0]), (54, [1.0, None]), (55, [math.nan, 1.0]), (56, [math.inf, 1.0]), (57, [1.0, -math.inf])]
    want, now = plain(good + bad, dims=2)
    assert got(spark, good + bad, dims=2, kind="double") == (want, now) and len(want) == 12
    assert got(spark, bad, dims=2) == ([], []) and got(spark, [], dims=2) == ([], [])
    assert centroids.with_inertia(*centroids.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0


def test_few_vectors_and_huge_components(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.5])]
    assert got(spark, few, dims=2, kind="double") == plain(few, dims=2)
    huge = [(i, [float(1 << (20 + i)), -float(3 << (i + 5))]) for i in range(25)] + [(90, [1.0, 1.0]), (91, [float(1 << 51), 0.0])]
    assert got(spark, huge, dims=2, kind="double") == plain(huge, dims=2)
    assert len(got(spark, [(1, [1e300, 1.0]), (2, [1.0, 1.0])], dims=2, kind="double")[0]) == 2


def test_bounds_save_scans(spark, monkeypatch):
    """After the first rounds most vectors are settled by their bounds alone."""
    rng = np.random.default_rng(3)
    before, now, scanned = None, None, []
    v = np.floor(np.concatenate([rng.normal(c, 0.05, (400, 8)) for c in (-2, 0, 2)]) * 1024).astype(np.int64)
    now = [v[i].tolist() for i in (0, 500, 1000)]
    real = centroids._scan
    monkeypatch.setattr(centroids, "_scan", lambda v, c: scanned.append(len(v)) or real(v, c))
    import pyarrow as pa

    state = {"row": pa.array(range(len(v))), "v": pa.array(v.tolist(), pa.list_(pa.int64()))}
    for _ in range(5):
        rows = pa.Table.from_batches(list(centroids._assign(before, now, False)(iter([pa.RecordBatch.from_pydict(state)]))))
        kept = rows.filter(rows.column("moved").is_null())
        cluster = kept.column("cluster").to_numpy()
        state |= {c: kept.column(c).combine_chunks() for c in ("cluster", "upper", "lower")}
        before, now = now, [(v[cluster == c].sum(axis=0) // (cluster == c).sum()).tolist() for c in range(3)]
    assert scanned[0] == len(v) and sum(scanned[1:]) < len(v) // 10
