"""Registered queries of the subpackage against their SQL."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import oracle_connection, rows_of  # noqa: E402

from tallyspark.llm import catalog  # noqa: E402


def check_oracle(spark, sf_dir: str, name: str) -> None:
    got = catalog.queries()[name](spark, sf_dir)
    want = oracle_connection(sf_dir).execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
