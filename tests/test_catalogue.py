"""Every registered structural query against its SQL twin in DuckDB, and those without one for rows."""

import math

import duckdb
import pytest
from protean import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        f = float(v)
        return (1, "nan" if math.isnan(f) else round(f, 4) + 0.0)
    return (2, str(v))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def _same(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and (x[1] == y[1] or x[0] == 1 and "nan" not in (x[1], y[1]) and math.isclose(x[1], y[1], rel_tol=1e-6, abs_tol=2e-4)) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    d = catalogue.queries()[name](spark, SF)
    got = _rows(d.columns, d.collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert _same(got[1], want[1])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for n in ("protean", "__spark_entry__.py"):
        s = os.path.join(root, n)
        (shutil.copytree(s, tmp_path / n) if os.path.isdir(s) else shutil.copy(s, tmp_path / n))
    shutil.rmtree(tmp_path / "protean" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'contact_map' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert e.oracle_sql().keys() <= q.keys()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0


def _gotoh(a, b):
    """Best global score, cell by cell: match 1, mismatch -1, a gap of n costs n + 1."""
    low = float("-inf")
    h, f = [0.0] + [-1.0 - j for j in range(1, len(b) + 1)], [low] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row, e = [-1.0 - i], low
        for j, y in enumerate(b, 1):
            f[j] = max(h[j] - 2, f[j] - 1)
            e = max(row[j - 1] - 2, e - 1)
            row.append(max(h[j - 1] + (1 if x == y else -1), e, f[j]))
        h = row
    return h[-1]


def test_alignments_are_of_whole_sequences(spark):
    from protean import catalogue

    sf = "/root/testdata/sf0.001"
    whole = {r.id: r.sequence for r in catalogue._sequences(spark, sf).collect()}
    assert max(map(len, whole.values())) > 60
    for r in catalogue.queries()["alignments"](spark, sf).collect():
        pair = whole[r.id], whole[r.id + 1]
        assert sorted((r.left.replace("-", ""), r.right.replace("-", ""))) == sorted(pair) and len(r.left) == len(r.right)
        assert r.id % 4 or r.score == _gotoh(*pair)
    msa = catalogue.queries()["progressive_msa"](spark, sf).collect()
    assert {r.name: r.aligned.replace("-", "") for r in msa} == whole and len(msa) == len(whole)
    assert len({(r.family, len(r.aligned)) for r in msa}) == len({r.family for r in msa})
