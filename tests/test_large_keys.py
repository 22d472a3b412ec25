"""Queries against their SQL on customers with larger keys than the given tables have, or without orders."""

import duckdb
import pytest

from tessera.plans import catalog


def held(spark, name, folder, **tables):
    """The query's rows and its SQL's, over these tables (path of the given table, DuckDB SELECT from it)."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.sql(f"COPY ({select}) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, str(folder)).select(want.columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["deck_part_id_scan", "deck_part_id_chain", "deck_part_id_quick"])
def test_part_ids(spark, sf_dir, tmp_path, name):
    keys = [0, 1, 7, 499_998, 499_999, 500_000, 899_999, 999_989, 999_999, 1_000_000, 1_500_000, 5_399_999, 99_000_000]
    got, want = held(spark, name, tmp_path, customer=f"SELECT unnest({keys})::BIGINT AS c_custkey")
    assert got == want and len(got) > 11


def test_part_ids_below(spark):
    """Without a bound of one's own it is a million, for all scans."""
    from tessera.sources.deck import Deck

    deck = Deck.parse(spark, "*PART\nname\n" + f"{1_000_000:>10}\n*PART\n" + f"{999_999:>10}\n{5:>10}\n")
    for bound, scanned, quick in (((), {5}, {999_999}), ((2_000_000,), {5, 1_000_000}, {999_999}), ((5,), set(), set())):
        assert {x.pid for x in deck.part_ids(*bound).collect()} == {x.pid for x in deck.part_names(*bound).collect()} == scanned
        assert {x.pid for x in deck.part_ids_quick(*bound).collect()} == quick


def test_text_cells(spark, tmp_path):
    """Texts of more than ten characters, which a part's cell hasn't."""
    keys = [0, 9, 9_999, 10_000, 89_999, 900_000, 5_399_999, 123_456_789, 9_999_999_999]
    got, want = held(spark, "deck_text_cells", tmp_path, customer=f"SELECT unnest({keys})::BIGINT AS c_custkey")
    assert got == want and len(got) == len(keys)


def test_without_orders(spark, sf_dir, tmp_path):
    """The name of a row whose customer has no orders becomes null."""
    given = lambda name: f"SELECT * FROM '{sf_dir}/{name}.parquet'"
    got, want = held(spark, "ordered_edits", tmp_path, customer=given("customer"), supplier=given("supplier"), orders=given("orders") + " WHERE o_custkey % 10 <> 5 AND o_custkey > 0")
    assert got == want and sum("None" in x for x in got) > 10
