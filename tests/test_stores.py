"""Versioned tables, run log, vector index, feature store."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipway.operators.runlog import RunLog
from slipway.operators.vectorindex import VectorIndex
from slipway.sources import tables as tb
from slipway.sources.features import FeatureStore


@pytest.fixture()
def tables(spark, tmp_path):
    return tb.Tables(spark, str(tmp_path))


def _df(spark, *ids):
    return spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, name string")


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_replace_append_reset_and_old_versions(spark, tables):
    assert tables.versions("t") == [] and tables.reset("t") is None
    with pytest.raises(FileNotFoundError):
        tables.read("t")
    assert tables.replace(_df(spark, 1, 2), "t") == 1
    reader = tables.read("t")
    assert tables.append(_df(spark, 3), "t") == 2 and _ids(tables.read("t")) == [1, 2, 3]
    assert tables.replace(_df(spark, 9), "t") == 3 and _ids(tables.read("t")) == [9]
    assert _ids(reader) == [1, 2] and _ids(tables.read("t", 2)) == [1, 2, 3]  # a reader goes on with its version
    assert tables.reset("t") == 4 and tables.read("t").count() == 0 and tables.read("t").columns == ["id", "name"]
    assert tables.append(_df(spark, 5), "t") == 5 and _ids(tables.read("t")) == [5]
    assert tables.forget("t", keep=1) == 4 and tables.versions("t") == [5] and _ids(tables.read("t")) == [5]
    assert len(tables.files.names("t/data")) == 1


def test_a_write_that_fails_leaves_the_old_table(spark, tables):
    tables.replace(_df(spark, 1), "t")
    bad = _df(spark, 2).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        tables.replace(bad, "t")
    assert _ids(tables.read("t")) == [1] and tables.versions("t") == [1]


def test_two_writers(spark, tables, monkeypatch):
    tables.replace(_df(spark, 1), "t")
    with pytest.raises(tb.Conflict):
        tables.files.create("t/commits/00000001", "{}")
    # another append gets in between writing the data and committing it
    write = tables._write

    def slow(df, name):
        out = write(df, name)
        monkeypatch.setattr(tables, "_write", write)
        tables.append(_df(spark, 7), "t")
        return out

    monkeypatch.setattr(tables, "_write", slow)
    tables.append(_df(spark, 2), "t")
    assert _ids(tables.read("t")) == [1, 2, 7]


def test_load_all(spark, tables):
    sources = {"a": _df(spark, 1, 2), "b": _df(spark), "c": None}
    with pytest.raises(FileNotFoundError, match="'c'"):
        tb.load_all(tables, sources)
    assert tables.versions("a") == []  # nothing was written
    for _ in range(2):
        got = {r["table_name"]: r["n_rows"] for r in tb.load_all(tables, sources, optional=("c",)).collect()}
        assert got == {"a": 2, "b": 0}
    got = {r["table_name"]: r["n_rows"] for r in tb.load_all(tables, sources, optional=("c",), reset=False).collect()}
    assert got == {"a": 4, "b": 0}


def test_publish_without_drivers(spark, tables):
    roll = spark.createDataFrame([(1, 0.2, 0.3, 9, "low"), (2, 0.5, 0.4, 7, "high")],
                                 "seller_id long, raw double, risk_score double, n_orders long, risk_band string")
    drivers = spark.createDataFrame([(1, [("f", 0.5)])], "seller_id long, top_features array<struct<feature:string,contribution:double>>")
    tb.publish_predictions(tables, roll, drivers, "m", dt.datetime(2024, 1, 2))
    got = {r["seller_id"]: r for r in tables.read("predictions").collect()}
    assert got[1]["top_features"][0]["feature"] == "f" and got[2]["top_features"] == []
    assert got[1]["model_name"] == "m" and got[2]["predicted_at"].year == 2024
    assert tables.commit_of("predictions")["notes"] == {"model_name": "m"}


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    assert log.records().count() == 0 and log.live().count() == 0
    with pytest.raises(LookupError):
        log.register_best("none")
    for run, best in (("r1", "b"), ("r2", "a"), ("r3", "b")):
        for m in ("a", "b"):
            log.log_run(run, m, {"depth": 3}, {"pr_auc": 0.9 if m == best else 0.5, "ks": None})
        log.register_best(run)
    assert [(r["version"], r["model"], r["stage"]) for r in log.stages().orderBy("version").collect()] == [
        (1, "b", "Archived"), (2, "a", "Archived"), (3, "b", "Production")]
    assert log.live().first()["version"] == 3 and log.records().count() == 6 + 3 + 5
    runs = log.runs()
    assert runs.count() == 6 and runs.filter("version is null").count() == 3
    # another writer took the next number: the record gets the one after
    names = log.files.names("records")
    stale = log.files.names
    log.files.names = lambda folder: (setattr(log.files, "names", stale), names[:-1])[1]
    log.log_run("r4", "a", {}, {"pr_auc": 0.1})
    assert log.records().count() == 15 and len(log.files.names("records")) == 15


def _docs(spark, *texts, source="s", band=None):
    return spark.createDataFrame([(f"d{i}-{source}", t, source, band) for i, t in enumerate(texts)],
                                 "id string, text string, source string, risk_band string")


def test_index_build_append_query(spark, tables):
    index = VectorIndex(tables)
    with pytest.raises(LookupError):
        index.query(spark.createDataFrame([(1, "x")], "query_id int, text string"))
    index.build(_docs(spark, "red fish", "red fish blue", "blue bird", "", None, band="high"))
    first = index.manifest()
    assert first["backend"] == "tfidf" and first["dim"] == 3  # red, fish, blue: in two chunks each
    index.build(_docs(spark, "blue blue unknown", source="t"), reset=False)
    rows = {r["chunk_id"]: r for r in index.chunks().collect()}
    assert index.manifest() == first and len(rows) == 5  # a null text has no chunk
    v = {r: np.sqrt(sum(x["weight"] ** 2 for x in c["vector"])) for r, c in rows.items()}
    assert all(abs(n - 1) < 1e-9 or n == 0 for n in v.values()) and v["d3-s_chunk0"] == 0
    assert rows["d0-s_chunk0"]["metadata"] == {"source": "s", "risk_band": "high"}
    assert rows["d0-t_chunk0"]["metadata"] == {"source": "t"}
    q = spark.createDataFrame([(1, "blue"), (2, "nothing known")], "query_id int, text string")
    got = {}
    for r in index.query(q, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["distance"], 6)))
    assert [len(x) for x in got.values()] == [4, 4]  # always k
    assert sorted(got[1])[0][1:] in (("d0-t_chunk0", 0.0), ("d2-s_chunk0", 0.0)) and sorted(got[1])[3][2] == 2.0
    assert [c for _, c, _ in sorted(got[2])] == sorted(rows)[:4] and {d for *_, d in got[2]} == {2.0}
    only = index.query(q, 4, {"source": "t"}).collect()
    assert {r["chunk_id"] for r in only} == {"d0-t_chunk0"}


def test_index_refuses_another_space(spark, tables):
    index = VectorIndex(tables)
    index.build(_docs(spark, "red fish", "red fish blue", "blue bird", "one", "two"))
    assert index.check("tfidf", 3)["dim"] == 3
    for backend, dim in (("sentence-model", None), ("tfidf", 384)):
        with pytest.raises(ValueError, match="build it again"):
            index.check(backend, dim)
    other = tables.read("chunks_vocabulary").withColumn("term", F.concat("term", F.lit("x")))
    tables.replace(other, "chunks_vocabulary")
    for act in (lambda: index.build(_docs(spark, "red"), reset=False),
                lambda: index.query(spark.createDataFrame([(1, "red")], "query_id int, text string"))):
        with pytest.raises(ValueError, match="vocabulary"):
            act()
    index.build(_docs(spark, "new words", "new words"), reset=True)
    assert index.check()["dim"] == 0  # both words are in too many of the two chunks


def test_feature_months(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "f"))
    rows = spark.range(120).select("id", F.expr("timestamp '2024-01-01 12:00:00' + make_dt_interval(cast(id as int))").alias("as_of_date"),
                                   (F.col("id") * 2).alias("x"))
    store.write(rows)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "f").rglob("*.parquet")}
    late = rows.withColumn("x", F.when(F.month("as_of_date") == 3, F.col("x") + 1).otherwise(F.col("x")))
    assert store.changed_months(rows) == [] and store.changed_months(late) == ["2024-03"]
    store.write(late.filter(F.month("as_of_date") == 3))
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "f").rglob("*.parquet")}
    kept = {p for p in files if "month=2024-03" not in str(p)}
    assert all(now[p] == files[p] for p in kept) and not {p for p in files if p not in kept} & set(now)
    assert sorted(map(tuple, store.read().select("id", "x").collect())) == sorted(map(tuple, late.select("id", "x").collect()))
    part = store.read(dt.datetime(2024, 2, 10), dt.datetime(2024, 3, 5))
    assert _ids(part) == list(range(40, 64))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan
