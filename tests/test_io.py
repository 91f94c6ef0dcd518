"""Sinks, catalog and sources on a scratch folder."""
from slipway.operators.signals import parse_series_payload
from slipway.sources import io


def test_catalog_roundtrip(spark, tmp_path):
    st = io.TableStore(spark, str(tmp_path / "db"))
    st.create_all()
    assert st.read_table("sellers").count() == 0
    rows = [("s1", 1000, "a", "SP"), ("s2", 2000, "b", "RJ")]
    df = spark.createDataFrame(rows, io.CATALOG["sellers"])
    st.write_df(df, "sellers", "append")
    st.write_df(df, "sellers", "append")
    assert st.read_table("sellers").count() == 4
    assert st.read_table("sellers", limit=1).count() == 1
    st.write_df(df, "sellers", "replace")
    assert st.read_table("sellers").count() == 2
    counts = {r["table_name"]: r["n_rows"] for r in st.row_counts(["sellers", "orders"]).collect()}
    assert counts == {"sellers": 2, "orders": 0}
    st.truncate("sellers")
    t = st.read_table("sellers")
    # file sources report every column nullable; names and types are kept
    assert t.count() == 0 and [(f.name, f.dataType) for f in t.schema] == \
        [(f.name, f.dataType) for f in io.CATALOG["sellers"]]
    out = st.export_snapshots(str(tmp_path / "snap"), ["sellers", "orders"], "csv")
    assert out == ["sellers", "orders"]


def test_bom_csv_and_files_check(spark, tmp_path):
    p = tmp_path / "sellers.csv"
    p.write_bytes("﻿seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,a,SP\n".encode("utf-8"))
    df = io.read_csv(spark, str(p), io.CATALOG["sellers"])
    assert df.first()["seller_id"] == "s1"
    try:
        io.verify_files_present(str(tmp_path), ["sellers.csv", "orders.csv", "items.csv"])
        raise AssertionError("expected failure")
    except FileNotFoundError as e:
        assert "orders.csv" in str(e) and "items.csv" in str(e)
    assert io.verify_files_present(str(tmp_path), ["sellers.csv"], ["signals.csv"]) == []
    empty = io.optional_source(spark, str(tmp_path / "nope"), io.CATALOG["external_signals"])
    assert empty.count() == 0 and empty.columns == io.CATALOG["external_signals"].fieldNames()


def test_series_payload_gaps(spark):
    payload = '{"observations": [{"date": "2020-01-01", "value": "50.12"}, {"date": "2020-01-02", "value": "."}]}'
    df = spark.createDataFrame([(payload,)], "payload string")
    out = parse_series_payload(df).collect()
    assert len(out) == 1 and out[0]["value"] == 50.12
    assert out[0]["date"].isoformat() == "2020-01-01"


def test_drop_and_create(spark, tmp_path):
    store = io.TableStore(spark, str(tmp_path / "db"))
    names = store.create_all()
    assert all(store.exists(t) and store.read_table(t).count() == 0 for t in names)
    store.drop_all()
    assert not any(store.exists(t) for t in names) and not store.exists("no_such_table")
