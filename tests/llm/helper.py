"""The same tables through a query and through its SQL."""

import duckdb


def same_as_sql(spark, folder, tables: dict, query, sql: str) -> int:
    """tables: name -> (rows, schema). Asserts equal rows and gives their number."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    found = query(spark, str(folder))
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    a = sorted((repr(tuple(r[c] for c in names)) for r in found.collect()))
    b = sorted(repr(tuple(r)) for r in want.fetchall())
    assert a == b, ([x for x in a if x not in b][:3], [x for x in b if x not in a][:3])
    return len(a)
