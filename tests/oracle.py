"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    ours, theirs = query(spark, sf), con.sql(sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.columns, ours.collect()) == rows_of(theirs.columns, theirs.fetchall())
