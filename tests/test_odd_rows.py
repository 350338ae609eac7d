"""Queries on rows that the generated tables don't have."""

import duckdb
import pytest

from codequarry.plans import catalogue


@pytest.fixture(scope="module")
def odd_people(spark, tmp_path_factory):
    """Folder of people of whom some have no emails, an empty list of them, or no name."""
    base = str(tmp_path_factory.mktemp("odd"))
    rows = [("a1", "Ann", ["ann@x.org"], 7), ("a2", "Ann", [], 7), ("a3", "Ann", None, 9), ("a4", None, ["bob-b@x.org"], 7), ("a5", "Bob B", ["bobb@y.org"], None), ("a6", "Ann", ["Ann@z.org"], 7)]
    spark.createDataFrame([(i, n, e, [], False, c) for i, n, e, c in rows], "id string, name string, emails array<string>, names array<string>, bot boolean, commits int").coalesce(1).write.parquet(f"{base}/people.parquet")
    return base


def test_handles_of_people_without_emails(spark, odd_people):
    got = {r.handle: r.people for r in catalogue.QUERIES["join_handle_person"](spark, odd_people).collect()}
    # a1, a2, a3 and a6 by the name or a mailbox; bob-b is a4 as it stands, and a4 and a5 without its dash
    assert got == {"ann": 4, "Ann": 4, "bob-b": 2, "bobb": 2}


def test_sort_people_without_emails(spark, odd_people):
    got = [r.id for r in catalogue.QUERIES["sort_people"](spark, odd_people).orderBy("position").collect()]
    assert got == ["a3", "a4", "a6", "a1", "a2", "a5"]
    con = duckdb.connect()
    con.execute(f"create view people as select * from '{odd_people}/people.parquet/*.parquet'")
    assert got == [r[1] for r in sorted(con.execute(catalogue.SQL["sort_people"]).fetchall())]
