"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(None if v != v else v for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.ORACLE[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hulls(spark, sf_dir):
    """Areas of hulls against a gift-wrapped hull of the same points."""
    import math

    from tessera.operators import mesh
    from tessera.plans.base import mesh_elements, mesh_nodes

    elements, nodes = mesh_elements(spark, sf_dir), mesh_nodes(spark, sf_dir)
    points = {}
    for r in mesh.corners(elements, nodes).select("pid", "x", "y").distinct().collect():
        points.setdefault(r.pid, []).append((r.x, r.y))

    def wrapped(own):
        start = at = min(own)
        ring = []
        while True:
            ring.append(at)
            new = own[0] if own[0] != at else own[1]
            for p in own:
                turn = (new[0] - at[0]) * (p[1] - at[1]) - (new[1] - at[1]) * (p[0] - at[0])
                if turn < 0:
                    new = p
            at = new
            if at == start:
                break
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2

    for r in mesh.projections(elements, nodes).collect():
        assert math.isclose(r.area, wrapped(points[r.pid]), rel_tol=1e-9)


def test_without_optional_parts(tmp_path):
    """Everything else works where the optional subpackage isn't installed."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
