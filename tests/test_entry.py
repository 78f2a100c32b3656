"""The registered queries on the smallest tables, and that they don't lean on the corpus subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[1]


def rows(frame, columns):
    clean = frame[columns].astype(object)
    return sorted(tuple(map(str, r)) for r in clean.where(clean.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_queries_match_their_sql(spark):
    import duckdb

    from veilframe.queries import QUERIES
    from veilframe.sql import ORACLES

    assert set(ORACLES) <= set(QUERIES)
    base = duckdb.connect()
    for name in os.listdir(SF):
        base.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    for name, query in QUERIES.items():
        got = query(spark, SF).toPandas()
        if name in ORACLES:
            expected = base.execute(ORACLES[name]).df()
            columns = sorted(got.columns)
            assert columns == sorted(expected.columns), name
            assert rows(got, columns) == rows(expected, columns), name


def test_entities_of_a_text_of_many_words_match_their_sql(spark, tmp_path):
    import duckdb

    from veilframe.queries import QUERIES
    from veilframe.sql import ORACLES

    texts = [(7, "ab c def " * 20_000), (8, "a bc"), (9, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, expected = QUERIES["bio_entities"](spark, str(tmp_path)).toPandas(), base.execute(ORACLES["bio_entities"]).df()
    columns = sorted(got.columns)
    assert got["last"].max() > 46_340  # its square is past 32 bits
    assert rows(got, columns) == rows(expected, columns)


def test_the_rest_stands_without_the_corpus_subpackage(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    n, m, corpus = done.stdout.split()
    assert int(n) >= int(m) > 30 and corpus == "False"


@pytest.mark.parametrize("missing", ["public_tokenizers", "ahocorasick", "veilframe.llm"])
def test_the_core_queries_stand_where_a_library_of_the_corpus_operators_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert done.returncode == 0, done.stderr
    n, m, corpus = done.stdout.split()
    assert int(n) >= int(m) > 30 and corpus == "False"
