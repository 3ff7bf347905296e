import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["score_hybrid", "knn_cosine", "bm25_phrase", "incremental_diff"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_without_optional_part(tmp_path):
    """The rest imports where the training-data operators aren't."""
    code = "import sys; sys.modules['corvane.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'knn_cosine' in e.queries() and 'pipeline' not in e.queries()"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
