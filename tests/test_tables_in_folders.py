"""Tables that are folders of files, and texts with accents, give what the SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for table in TABLES:
        if table in ("documents", "events"):
            os.mkdir(root / f"{table}.parquet")
            for i in range(3):
                con.execute(f"COPY (SELECT * FROM '{SF}/{table}.parquet' WHERE {'doc_id' if table == 'documents' else 'event_id'} % 3 = {i}) TO '{root}/{table}.parquet/part-{i}.parquet' (FORMAT parquet)")
        elif table == "conversations":
            texts = "values (1, 0, 'user', 'Èla caña'), (1, 1, 'user', 'voilà la mer'), (2, 0, 'user', 'queé que la'), (3, 0, 'user', 'laé'), (4, 0, 'user', 'la_ der2 the')"
            con.execute(f"COPY (SELECT conv_id::bigint as conv_id, turn::bigint as turn, role, text FROM ({texts}) t(conv_id, turn, role, text)) TO '{root}/{table}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{table}.parquet", root / f"{table}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["accumulate_context", "stream_ingest", "stream_state", "stream_alerts"])
def test_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert want[1] and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
