"""orphaned_keys where several orders of a customer share a flow, against its SQL."""

import duckdb

from flowtide.plans import registry

SF = "/root/testdata/sf0.001"


def test_shared_flows(spark, tmp_path):
    """Orders 28,000 apart have one flow, and every third of those that they are numbered by differs."""
    con = duckdb.connect()
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"COPY (SELECT t.* REPLACE ({key} + 28000 * i AS {key}) FROM '{SF}/{table}.parquet' t, range(3) r(i)) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(f"SELECT community_id, host, last_ns FROM ({registry.ORACLE_SQL['orphaned_keys']})").fetchall()
    got = registry.QUERIES["orphaned_keys"](spark, str(tmp_path)).select("community_id", "host", "last_ns").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
