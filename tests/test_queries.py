"""Registered queries against their DuckDB equivalents on the smallest tables."""

import glob
import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

CHOSEN = ("log_to_slang", "log_to_slang_order_lines", "dfg_order_lines", "log_to_sdfa", "dfg_to_sdfa", "sdfa_trace_probability", "retain_traces_by_attribute", "ocel_flatten_part", "attribute_profile", "sdfa_to_slpn", "dfg_scc")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_duckdb(spark, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_llm_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tracewright"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
