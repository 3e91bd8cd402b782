import pytest

from photarium import catalog, catalog_services, catalog_values  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_twin(name, spark, sf_dir, same):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_whole_merge_grows_with_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    keys = F.col("id") + 1
    segment = F.when(keys % 5 == 0, "BUILDING").otherwise("FURNITURE")
    rows = spark.range(2000).select(keys.alias("c_custkey"), F.concat(F.lit("Customer#"), keys).alias("c_name"), F.lit(1).alias("c_nationkey"), segment.alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["import_merge"](spark, str(tmp_path)).collect()
    assert len(got) == 2400 and {r["old_main"] for r in got} - {None} == {r["old_other"] for r in got} - {None} == set(range(1, 2001))


def test_upsert_with_odd_keys(spark, tmp_path):
    """Keys that repeat, are 0, negative or null lose no row of the SQL."""
    import duckdb

    keys = [0, 1, 1, 1, 2, -2, 3, 3, None, None, 4, 5, -5, 6]
    rows = [(k, ("BUILDING", "FURNITURE", "BUILDING", None)[i % 4], (1.0, -1.0, None, -0.0, float("nan"))[i % 5]) for i, k in enumerate(keys)] + [(7, "BUILDING", -1.0)] * 3
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["upserted"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(db.execute(catalog.ORACLES["upserted"]).fetchall(), key=repr)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """In a copy without the subpackage and its tests, with and without the pipeline's file."""
    import pathlib
    import shutil
    import subprocess
    import sys

    own = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(own, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    check = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and not any(k.startswith(('op', 'pipeline')) for k in q), sorted(q)"
    for name in ("corpus_pipeline.py", None):
        subprocess.run([sys.executable, "-c", check], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin"})
        if name:
            (tmp_path / "copy" / name).unlink(missing_ok=True)
