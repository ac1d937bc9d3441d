"""The driver contract: entry, queries and oracle_sql."""

import __spark_entry__ as E
from conftest import core_queries


def test_entry_schema_is_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema and a.count() > 0


def test_every_query_of_the_library_has_an_oracle():
    q, o = set(core_queries()), set(E.oracle_sql())
    assert len(q) == 63 and q <= o <= set(E.queries())
    ids = {k.split("_")[0] for k in q}
    want = ({f"io{i}" for i in range(1, 7)} | {f"p{i}" for i in range(1, 16)} |
            {f"t{i}" for i in range(1, 9)} | {f"j{i}" for i in range(1, 7)} |
            {f"v{i}" for i in range(1, 5)} | {f"a{i}" for i in range(1, 9)} |
            {f"w{i}" for i in range(1, 8)} | {f"st{i}" for i in range(1, 5)} | {f"r{i}" for i in range(1, 5)})
    assert ids == want
