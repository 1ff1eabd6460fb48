import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SMALL = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))
needs_data = pytest.mark.skipif(not SMALL.exists(), reason="test tables absent")

SAMPLE = ("latest_per_task", "outcome_states", "edit_goals", "changed_lines", "panel_selection", "proximity_clusters", "scored_bugs", "noise_floor",
          "sign_permutation_exact", "replayed_states", "line_mutants", "sweep_findings", "assembled_answers")


def test_every_oracle_names_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) >= 120


@needs_data
def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    from compare import TABLES, norm
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = entry_module.queries()[name](spark, str(SMALL))
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    mine = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=key)
    assert mine == theirs
