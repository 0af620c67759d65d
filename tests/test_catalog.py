"""Each query gives the rows of its SQL."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tallyforge.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events pages".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(catalog.oracle_sql()[name])
    expected = rows([d[0] for d in rel.description], rel.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
