"""The driver's contract, with the training-data subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from goldpan.operators import term_weights
from goldpan.plans import queries as own

SF = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows, columns):
    def one(v):
        if v is None or v != v:
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    got = own.QUERIES[name](spark, str(SF))
    rows = got.collect()
    if name not in own.ORACLE:
        assert rows
        return
    want = duck.execute(own.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert values(rows, got.columns) == values(want.fetchall(), columns)


def test_tokens_of_odd_texts(spark, tmp_path):
    """Texts without a word, null, and letters that Java and SQL put in lower case differently."""
    texts = ["", " ", "!?", "\u00e9", None, "\u0130stanbul A", "\u0391\u03a3 b", "One two 3 four five six"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(f"WITH documents AS (FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')) {own.ORACLE['tokens']}")
    got = own.QUERIES["tokens"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.columns == want.columns


@pytest.mark.parametrize("name", ["tfidf_weights", "tfidf_char_weights"])
def test_term_weights_of_odd_texts(spark, tmp_path, monkeypatch, name):
    """Wide and combining letters, odd white space, repeated ids, no term; terms in the broadcast and beyond it, few in a buffer."""
    texts = ["", " ", None, "a", "\u0130stanbul \u0130stanbul x", "\u0391\u03a3 \u0391\u03a3", "\u4e2d\u6587\u5b57 \u4e2d\u6587\u5b57\u3000\u4e2d\u6587", "x\x1cyz x\u2003yz\x85yz", "ab \u2776cd \u2776cd e\u0301f", "\U0001f600\U0001f600\U0001f600 ab", "abc ab abcd"]
    rows = [(i, t) for k in range(4) for i, t in enumerate(texts, 20 * k)] + [(0, "ab abc"), (10, "abcd ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(f"{own.ORACLE[name].replace('WITH ', f'WITH documents AS (FROM read_parquet({chr(39)}{tmp_path}/documents.parquet/*.parquet{chr(39)})), ', 1)}")
    columns, want = want.columns, want.fetchall()
    for held, buffer in ((1 << 20, 1 << 20), (6, 8), (0, 1)):
        monkeypatch.setattr(term_weights, "HELD", held)
        monkeypatch.setattr(term_weights, "BUFFER", buffer)
        got = own.QUERIES[name](spark, str(tmp_path))
        assert values(got.collect(), got.columns) == values(want, columns)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    """With the folders and the pipeline deleted all else imports and its queries are there."""
    for name in ("goldpan", "__spark_entry__.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "goldpan" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.own.QUERIES))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
    assert got.stdout.strip() == "True", got.stderr


def test_nothing_outside_imports_the_subpackage():
    for path in (REPO / "goldpan").rglob("*.py"):
        if "llm" not in path.parts:
            assert "goldpan.llm" not in path.read_text(), path
