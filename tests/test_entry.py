import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path(entry.SMOKE_DIR)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "p4_found", "p5_found"} <= set(entry.queries())


def test_the_core_does_not_import_the_corpus_operators():
    for path in (ROOT / "loreloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("loreloom.llm") for n in names), path


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_every_query_runs(spark):
    for name, query in entry.queries().items():
        assert query(spark, str(SMALL)).count() >= 0, name


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["session_id", "entry_key", "valid_from_seq", "valid_to_seq"]


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_retrieve_context_is_made_of_small_plans(spark):
    duckdb = pytest.importorskip("duckdb")
    got = entry.queries()["retrieve_context"](spark, str(SMALL))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # What its parts share is read from tables that were written once, not worked out again in one large plan.
    assert plan.count("Exchange") <= 4 and "character_states.parquet" not in plan and "retrieval_contexts.parquet" not in plan
    with duckdb.connect() as base:
        for path in SMALL.glob("*.parquet"):
            base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        rows = base.execute(entry.oracle_sql()["retrieve_context"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows) and {r[0] for r in rows} >= {"characters", "groups", "lines"}
