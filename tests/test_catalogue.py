"""Every catalogue query against its SQL in DuckDB, and plans that must stay as they are."""

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    wanted = sorted((tuple(plain(x) for x in r) for r in want.select(*columns).fetchall()), key=str)
    assert rows == wanted and rows


@pytest.mark.parametrize("snapshot, n", [(100, 52), (2500, 121), (5000, 123), (10000, 120)])
def test_latest_counts(spark, snapshot, n):
    assert queries.view(spark, SF, snapshot).count() == n


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_reaches_the_scan(spark):
    assert "LessThanOrEqual(event_id,2499)" in plan(queries.kv_asof(spark, SF))


def test_key_reaches_the_scan(spark):
    assert "EqualTo(user_id,42)" in plan(queries.kv_get(spark, SF))


def test_latest_is_hash_aggregated_with_partial_sums(spark):
    text = plan(queries.kv_latest(spark, SF))
    assert "HashAggregate" in text and "SortAggregate" not in text and "partial_max_by" in text


def test_garbage_collection_needs_no_python(spark):
    assert "Python" not in plan(queries.kv_gc(spark, SF))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "value", "seq"]
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_probe_of_a_filter_stays_one_row(spark):
    assert "Generate" not in plan(queries.kv_bloom_prune(spark, SF))


def test_the_store_s_files_hold_little_more_than_entries(spark):
    """Filters of a fixed size were 1 MB a file."""
    store, _ = queries._stored(spark, SF)
    files, kept = store.manifest.files, store.ops().count()
    assert kept == sum(f.entries for f in files) and sum(f.size for f in files) < 100 * kept + 4000 * len(files) and len(files) < 10
