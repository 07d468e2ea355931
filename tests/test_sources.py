"""Files, settings, reports and the upsert stream."""

from __future__ import annotations

import json

import pytest

from setlens.sources import files, index, reports, settings
from setlens.streaming.upsert import UpsertStore, upsert_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1, "s": "é"}\n\n{"i": 2, "s": null}\n', encoding="utf-8")
    df = files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "i int, s string")
    assert rows(df.select("i")) == [(1,), (2,)]
    files.write_json_lines(df, str(tmp_path / "out"), "i")
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"i": 1, "s": "é"}, {"i": 2, "s": None}] and "é" in text
    (tmp_path / "bad.jsonl").write_text('{"i": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "i int").collect()


def test_split_lists_and_images(spark, tmp_path):
    for s, ids in (("train", "a\n\n b \n"), ("val", "c"), ("test", "")):
        (tmp_path / f"{s}.txt").write_text(ids)
    assert rows(files.read_split_lists(spark, str(tmp_path)).select("sample_id", "split")) == [("a", "train"), ("b", "train"), ("c", "val")]
    (tmp_path / "img" / "x").mkdir(parents=True)
    for n in ("1_2.JPG", "x/3_4.png", "note.txt"):
        (tmp_path / "img" / n).write_bytes(b"123")
    assert rows(files.list_images(spark, str(tmp_path / "img")).select("image_id", "size")) == [("1_2", 3), ("3_4", 3)]


def test_summary_has_all_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    files.write_summary([a, b], str(tmp_path / "s"))
    lines = next((tmp_path / "s").glob("part-*")).read_text().splitlines()
    assert lines[0] == "x,y,z" and sorted(lines[1:]) == ["1,2,", "3,,4"]


def test_publish_replaces_stale_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    files.publish(df, str(tmp_path), {"run": 1})
    files.write_document(str(tmp_path / "metrics.json"), {"map": 1})
    files.publish(df, str(tmp_path), {"run": 2})
    assert not (tmp_path / "metrics.json").exists()
    got, meta = files.read_published(spark, str(tmp_path))
    assert rows(got) == [(1,)] and meta == {"run": 2}
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, str(tmp_path / "none"))
    assert len(files.file_digest(str(tmp_path / "metadata.json"))) == 64


def test_index_lines(spark):
    df = spark.createDataFrame([("1 2 3  4 5 6 77 0",), ("  ",)], "value string")
    assert rows(index.parse_index(df)) == [("1_2", "77", 3, 4, 5, 6)]
    with pytest.raises(Exception, match="not eight fields"):
        index.parse_index(spark.createDataFrame([("1 2 3",)], "value string")).collect()


def test_settings(tmp_path):
    settings.save(str(tmp_path / "c.yaml"), {"a": {"b": 1}, "c": "x"})
    base = settings.load(str(tmp_path / "c.yaml"))
    assert settings.override(base, settings.parse_overrides(["a.b=2"])) == {"a": {"b": 2}, "c": "x"}
    for bad in ("a.z=1", "q=1", "c.d=1"):
        with pytest.raises(KeyError):
            settings.override(base, settings.parse_overrides([bad]))
    for bad in (["a"], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            settings.parse_overrides(bad)
    rules = {"m": (int, 5, 1, 10), "w": (float, 0.5, 0.0, 1.0), "on": (bool, True, None, None)}
    assert settings.check({"w": 1}, rules) == {"m": 5, "w": 1.0, "on": True}
    for bad in ({"x": 1}, {"m": 11}, {"m": True}, {"w": float("nan")}, {"on": 1}):
        with pytest.raises(ValueError):
            settings.check(bad, rules)


def test_reports(tmp_path):
    data = [{"method": "a_b", "map": 0.5, "r1": None}, {"method": "c", "map": 0.12345, "r1": 1.0}]
    reports.write_reports(data, "method", ["map", "r1"], str(tmp_path / "t"))
    assert (tmp_path / "t.csv").read_text() == "method,map,r1\na_b,0.5,\nc,0.12345,1.0\n"
    assert "| a_b | 50.00 | — |" in (tmp_path / "t.md").read_text()
    assert r"a\_b & 50.00 & -- \\" in (tmp_path / "t.tex").read_text()
    with pytest.raises(ValueError):
        reports.render(data, "method", ["map"], "html")


def test_upsert_stream_applies_each_batch_once(spark, tmp_path):
    store = UpsertStore(str(tmp_path / "store"), "k", "pos")
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "c", 3)], "k int, v string, pos bigint").write.parquet(str(src / "p0"))
    read = lambda: spark.readStream.schema("k int, v string, pos bigint").option("recursiveFileLookup", "true").parquet(str(src))
    upsert_stream(read(), store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.read(spark).select("k", "v")) == [(1, "c"), (2, "b")]
    spark.createDataFrame([(2, "d", 9), (3, "e", 10)], "k int, v string, pos bigint").write.parquet(str(src / "p1"))
    upsert_stream(read(), store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.read(spark).select("k", "v")) == [(1, "c"), (2, "d"), (3, "e")]
    batch = store.state()["batch"]
    store.apply(spark.createDataFrame([(1, "x", 99)], "k int, v string, pos bigint"), batch)
    assert rows(store.read(spark).select("k", "v")) == [(1, "c"), (2, "d"), (3, "e")]


def test_csv_cells_are_quoted_where_they_need_it():
    from setlens.sources.reports import render

    assert render([{"m": 'a, "b"', "x": 0.5, "y": None}], "m", ["x", "y"], "csv") == 'm,x,y\n"a, ""b""",0.5,\n'
