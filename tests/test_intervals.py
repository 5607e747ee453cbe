"""Coverage by intervals against SQL where values are missing, reversed or equal."""

import duckdb
import pytest

from sparkfen.plans import catalog
from tests.differential import rows_of

FOLDER = "/root/testdata/sf0.001"
CASES = {
    "missing values": f"select * replace (case when event_id % 7 = 0 then null else value end as value) from '{FOLDER}/events.parquet'",
    "missing ids": f"select * replace (case when event_id % 7 = 0 then null else event_id end as event_id) from '{FOLDER}/events.parquet'",
    "negative ids": f"select * replace (-event_id as event_id) from '{FOLDER}/events.parquet'",
    "equal rows": f"select e.* from '{FOLDER}/events.parquet' e, range(60)",
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_against_sql(spark, tmp_path, case):
    con = duckdb.connect()
    con.execute("set threads = 1")  # the SQL's two windows may order equal rows differently in more
    con.execute(f"copy ({CASES[case]}) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = catalog.queries()["interval_union"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(con.execute(catalog.oracle_sql()["interval_union"]).df())
