"""Every registered sensor query against its SQL in DuckDB, and the driver's entry points."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from sweepline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(v) -> str:
    if v is None or v != v:
        return "null"
    return str(v) if isinstance(v, (str, bool)) else repr(round(float(v), 9))


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_value, r)) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_results_have_rows(spark):
    for name in ("rejected_boxes", "out_of_order", "scan_merged_run", "detector_chain"):
        assert catalog.QUERIES[name](spark, SF).count() > 0, name


def _queue(points, tol, least, most):
    """Breadth-first growth with the soft limit, in plain Python: point_idx to cluster."""
    import math

    line, used, out, number = sorted(points), set(), {}, 0
    where = dict(points)
    for seed, _ in line:
        if seed in used:
            continue
        members, waiting = [], [seed]
        while waiting:
            p = waiting.pop(0)
            if p not in used:
                used.add(p)
                members.append(p)
                if len(members) < most:
                    waiting += [q for q, xyz in line if math.dist(where[p], xyz) < tol]
        if len(members) >= least:
            out |= dict.fromkeys(members, number)
            number += 1
    return out


def test_capped_clusters_are_those_of_a_queue(spark):
    from sweepline.operators.clouds import distinct_points
    from sweepline.plans import bindings

    got: dict = {}
    for r in catalog.QUERIES["euclid_clusters_capped"](spark, SF).collect():
        got.setdefault(r.frame_id, {})[r.point_idx] = r.cluster_id
    frames: dict = {}
    for r in distinct_points(bindings.small(spark, SF)).collect():
        frames.setdefault(r.frame_id, []).append((r.point_idx, (r.x, r.y, r.z)))
    want = {f: c for f, p in frames.items() if (c := _queue(p, catalog.TOL, catalog.LEAST, 10))}
    assert got == want


def test_lidar_pipeline_with_the_recorders_limits(spark):
    """Clusters of 7 to 150 points, as the recorder's software has them, against a plain queue on the points that are left."""
    import dataclasses

    from sweepline.operators.clouds import distinct_points
    from sweepline.plans import bindings, pipelines

    sf = "/root/testdata/sf0.01"
    p = dataclasses.replace(catalog.PIPE, tol=9.0, least=7, most=12)
    r = pipelines.lidar(bindings.small(spark, sf), p, catalog._RULE)
    frames: dict = {}
    for x in distinct_points(r.outliers.select("frame_id", "point_idx", "x", "y", "z", "intensity")).collect():
        frames.setdefault(x.frame_id, []).append((x.point_idx, (x.x, x.y, x.z)))
    want = {(f, i, c) for f, pts in frames.items() for i, c in _queue(pts, 9.0, 7, 12).items()}
    assert {(x.frame_id, x.point_idx, x.cluster_id) for x in r.clusters.collect()} == want and len(want) > 50


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
