"""Every query with SQL gives the SQL's rows; the others run. Nothing outside the llm folder needs it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import compare, views

from citeloom.plans import problem_sql, problems, reference, reference_sql

QUERIES = reference.queries() | problems.queries()
ORACLES = reference_sql.ORACLES | problem_sql.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, root, name):
    if name in ORACLES:
        assert compare(spark, views(root), root, QUERIES[name], ORACLES[name]) == ""
    else:
        got = [tuple(r) for r in QUERIES[name](spark, root).collect()]
        assert got and len(set(map(str, got))) == len(got)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_core_stands_alone(tmp_path):
    """A copy without both llm folders imports, has the core's queries and runs tests of its own."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=240, env={**os.environ, "PYTHONPATH": "."})
    got = run("-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], got.stderr
    got = run("-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "tests", "-k", "test_entry or citation_network or p5_found or weighted_cooccurrence or packed_values")
    assert got.returncode == 0 and " passed" in got.stdout, got.stdout


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "year", "novelty"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def signed_scores(spark, tmp_path, name):
    """Of a density query over orders that share few vectors, and of its SQL: every key's scores by value and sign; equal zeros may come in any order."""
    con = views(str(tmp_path))
    con.execute(f"copy (select range as o_orderkey, range % 3 as o_custkey, timestamp '1996-03-01' + to_years(range // 20) as o_orderdate from range(60)) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select range as c_custkey from range(5)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select range as vec_id, list_transform(range(8), lambda k: sin(range * 8 + k + 1))::float[] as embedding from range(9)) to '{tmp_path}/embeddings.parquet'")
    con = views(str(tmp_path))
    cur = con.execute(ORACLES[name])
    keyed = lambda cols, rows: sorted((sorted((c, repr(v)) for c, v in zip(cols, r) if c != "scores"), sorted(map(repr, r[cols.index("scores")]))) for r in rows)
    want = keyed([c[0] for c in cur.description], cur.fetchall())
    df = QUERIES[name](spark, str(tmp_path))
    assert {"0.0", "-0.0"} <= {s for _, scores in want for s in scores}
    return keyed(df.columns, [tuple(r) for r in df.collect()]), want


def test_author_intra_density_keeps_signs(spark, tmp_path):
    got, want = signed_scores(spark, tmp_path, "author_intra_density")
    assert got == want


def test_author_inter_density_keeps_signs(spark, tmp_path):
    got, want = signed_scores(spark, tmp_path, "author_inter_density")
    assert got == want


def test_author_inter_density_orders_zeros(spark, tmp_path):
    """Distances that round to zero keep the order that they had: those below 0 come first, in every run, where the SQL leaves it open."""
    signed_scores(spark, tmp_path, "author_inter_density")  # writes the tables
    rows = QUERIES["author_inter_density"](spark, str(tmp_path)).collect()
    signs = ["".join(str(x)[0] for x in r.scores if x == 0) for r in rows]
    assert any("-0" in s for s in signs) and not any("0-" in s for s in signs)
