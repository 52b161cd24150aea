"""Queries against their DuckDB forms on documents with blank and missing fields."""

import os

import duckdb
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"
ODD = f"""select * replace (
    case when doc_id % 37 = 5 then null when doc_id % 37 = 6 then '' when doc_id % 37 = 7 then '  ' || chr(10) when doc_id % 37 = 8 then chr(160) || text || chr(12288) else text end as text,
    case when doc_id % 41 = 5 then null when doc_id % 41 = 6 then '' when doc_id % 41 = 7 then ' en ' else lang end as lang,
    case when doc_id % 43 = 5 then null when doc_id % 43 = 6 then '' when doc_id % 43 = 7 then ' s ' else source end as source)
    from '{SF}/documents.parquet'"""


@pytest.mark.parametrize("name", ["Q9_prompts", "Q10_study_guide"])
def test_odd_documents(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy ({ODD}) to '{tmp_path}/documents.parquet' (format parquet)")
    for f in os.listdir(SF):
        if not (tmp_path / f).exists():
            (tmp_path / f).symlink_to(f"{SF}/{f}")
        con.execute(f"create view {f.split('.')[0]} as select * from '{tmp_path}/{f}'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
