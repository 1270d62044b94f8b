import hashlib
import io
import math
import os
import zipfile
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloam.functions import stats
from gridloam.functions import text as T
from gridloam.operators import assets, calendar, compare, evaluation, gaps, grid, regions, regrid, retrieval, sensors, trend
from gridloam.sources import files
from gridloam.sources.tables import clean
from gridloam.streaming.daily import daily_means

DAY = date(2020, 1, 1)
OBS = "obs_date date, cell_id long, x double, y double, value double"


def cube(spark, values):
    """{cell: [value of day 0, ...]}; "-" is an absent row, None a missing value."""
    rows = [(DAY + timedelta(days=d), c, float(c % 2), float(c // 2), v) for c, vs in values.items() for d, v in enumerate(vs) if v != "-"]
    return spark.createDataFrame(rows, OBS)


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double").select(clean(F.col("v")).alias("value"))
    assert df.agg(F.avg("value"), F.count("value")).first() == (1.0, 1)


def test_slopes_compact_and_gapped(spark):
    obs = cube(spark, {0: [1.0, "-", 2.0, 3.0], 1: [None, 5.0, None, 7.0]})
    one = cube(spark, {0: [1.0, None, 2.0, 3.0]})
    assert trend.region_trend(one).first()["slope"] == pytest.approx(1.0)  # days are numbered on over the gap
    cells = {r["cell_id"]: (r["value"], r["n"]) for r in trend.cell_trend(obs).collect()}
    x = np.array([0, 2, 3])
    assert cells[0] == (pytest.approx(np.polyfit(x, [1, 2, 3], 1)[0]), 3) and cells[1] == (None, 2)


def test_short_and_constant_series(spark):
    for n in range(4):
        t = trend.with_p_value(trend.region_trend(cube(spark, {0: [float(v * v) for v in range(n)] or [None]}))).first()
        assert t["n"] == n
        if n < 2:
            assert (t["slope"], t["r2"], t["p_value"]) == (0.0, 0.0, 1.0)
    flat = trend.with_p_value(trend.region_trend(cube(spark, {0: [3.0] * 6}))).first()
    assert (flat["slope"], flat["r2"], flat["p_value"]) == (0.0, 0.0, 1.0)
    spans = compare.periods(spark, [("2020-01-01", "2020-01-02"), ("2020-01-01", "2020-01-03")])
    got = {r["period_idx"]: r for r in compare.compare_periods(cube(spark, {0: [1.0, 2.0, 3.0]}), spans, "slope").collect()}
    assert got[0]["value"] is None and got[1]["value"] == pytest.approx(1.0) and got[1]["winner"]


def test_p_values():
    # two-sided points of Student's t: 2.228 at 10 degrees of freedom, 1.96 far out
    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (2.75, 30, 0.01), (1.962, 1000, 0.05)):
        assert stats.p_value(t / math.sqrt(df + t * t), df + 2) == pytest.approx(p, rel=2e-3)
    assert stats.p_value(0.0, 10) == pytest.approx(1) and stats.p_value(1.0, 10) == 0 and stats.p_value(0.3, 2) == 0 and stats.p_value(0.5, 1) == 1


def test_missing_share(spark):
    obs = cube(spark, {0: [1.0, None, "-", 2.0], 3: [1.0, 1.0, 1.0, 1.0]})
    cells = spark.createDataFrame([(i, float(i % 2), float(i // 2)) for i in range(4)], "cell_id long, x double, y double")
    got = grid.missing_share(obs, cells.where("cell_id in (0, 3)"), "2020-01-01", "2020-01-05", cells).first()
    assert (got["n_valid"], got["region_cells"], got["window_cells"]) == (6, 2, 4)
    assert got["missing_pct_region"] == pytest.approx(40) and got["missing_pct_window"] == pytest.approx(70)


def test_national_counts_a_border_cell_once(spark):
    bridge = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "cell_id long, region string")
    obs = cube(spark, {0: [1.0], 1: [3.0], 2: [9.0]})
    assert grid.in_region(obs, bridge, "india").agg(F.avg("value")).first()[0] == 2.0
    assert grid.in_region(obs, bridge, "A").count() == 1


def test_gaps(spark):
    obs = cube(spark, {0: [1.0, None, "-", 2.0, "-", 3.0]})
    runs = sorted(tuple(r) for r in gaps.runs(gaps.missing_days(spark, obs, "2020-01-01", "2020-01-08")).collect())
    assert runs == [(date(2020, 1, 2), date(2020, 1, 3), 2), (date(2020, 1, 5), date(2020, 1, 5), 1), (date(2020, 1, 7), date(2020, 1, 8), 2)]
    report = gaps.report(spark, obs, "2020-01-01", "2020-01-08").first()
    assert (report["total_expected"], report["total_missing"], report["total_available"], report["flagged"]) == (8, 5, 3, True)


def test_winners(spark):
    obs = cube(spark, {0: [2.0, 2.0, 5.0, 1.0]})
    spans = compare.periods(spark, [("2020-01-01", "2020-01-01"), ("2020-01-02", "2020-01-02"), ("2020-01-01", "2020-01-04"), ("2021-01-01", "2021-01-02")])
    first = lambda m: compare.compare_periods(obs, spans, m).where("winner").first()["period_idx"]
    assert first("min") == 2 and first("max") == 2 and first("mean") == 2
    two = compare.periods(spark, [("2020-01-01", "2020-01-01"), ("2020-01-02", "2020-01-02")])
    assert compare.compare_periods(obs, two, "max").where("winner").first()["period_idx"] == 0
    assert compare.complete(compare.compare_periods(obs, spans, "mean")).count() == 0


@pytest.mark.parametrize("grain,labels", [("week", ["2020-01-05", "2020-01-12", "2020-01-19"]), ("month", ["2020-01-31"]), ("quarter", ["2020-03-31"]), ("year", ["2020-12-31"])])
def test_resample_labels_and_empty_buckets(spark, grain, labels):
    days = spark.createDataFrame([("a", date(2020, 1, 2), 1.0), ("a", date(2020, 1, 15), 3.0)], "region string, obs_date date, value double")
    got = {str(r["bucket"]): r["value"] for r in calendar.resample(days, grain).collect()}
    assert sorted(got) == labels and (grain != "week" or got["2020-01-12"] is None)


def test_heatmap(spark):
    days = spark.createDataFrame([(date(2020, 1, 2), 1.0), (date(2020, 1, 3), 3.0), (date(2021, 12, 3), 5.0)], "obs_date date, value double")
    got = {r["year"]: r for r in calendar.heatmap(days).collect()}
    assert got[2020]["m1"] == 2.0 and got[2020]["m2"] is None and got[2021]["m12"] == 5.0


def test_point_in_polygon(spark):
    square = lambda x0, y0, s: [(x0, y0), (x0 + s, y0), (x0 + s, y0 + s), (x0, y0 + s)]
    polys = [("left ", [square(0.0, 0.0, 2.0)]), ("right", [square(2.0, 0.0, 2.0)]), ("RING", [square(10.0, 10.0, 4.0), square(11.0, 11.0, 2.0)]), ("bay", [[(20.0, 0.0), (24.0, 0.0), (24.0, 4.0), (22.0, 1.0), (20.0, 4.0)]])]
    layer = spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in r] for r in rings]) for n, rings in polys], "region string, rings array<array<struct<x:double,y:double>>>")
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 10.5, 12.0), (4, 12.0, 12.0), (5, 22.0, 3.0), (6, 20.5, 1.0), (7, 99.0, 9.0)], "cell_id long, x double, y double")
    assert sorted(map(tuple, regions.bridge(cells, layer).collect())) == [(1, "left"), (2, "right"), (3, "ring"), (6, "bay")]
    assert regions.catalogue(layer).count() == 4


def test_regrid(spark):
    source = spark.createDataFrame([(float(x), float(y), None if (x, y) == (2, 2) else 10.0 * x + y) for x in range(3) for y in range(3)], "x double, y double, value double")
    target = spark.createDataFrame([(0.5, 0.25), (1.0, 1.0), (1.5, 1.5), (2.5, 0.0), (2.0, 1.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["value"] for r in regrid.linear(source, target).collect()}
    assert got == {(0.5, 0.25): 5.25, (1.0, 1.0): 11.0, (1.5, 1.5): None, (2.5, 0.0): None, (2.0, 1.0): 21.0}
    near = {(r["x"], r["y"]): r["value"] for r in regrid.nearest(source, target).collect()}
    assert near[(0.5, 0.25)] == 10.0 and near[(1.5, 1.5)] is None and near[(2.5, 0.0)] is None


def test_regrid_on_uneven_axes(spark):
    """By hand, at every pair of an axis: inside, on a value, on the last one, outside, and beside a missing corner."""
    xs, ys = [0.0, 1.0, 4.0, 10.0], [-2.0, 0.0, 0.5]
    f = lambda x, y: 3 * x - 2 * y + x * y
    rows = [(x, y, f(x, y)) for x in xs for y in ys if (x, y) != (10.0, 0.5)]
    source = spark.createDataFrame(rows, "x double, y double, value double")
    asked = [(x, y) for x in (-0.1, 0.0, 0.25, 1.0, 2.5, 7.0, 10.0, 10.5) for y in (-3.0, -2.0, -1.0, 0.0, 0.3, 0.5, 1.0)]
    target = spark.createDataFrame(asked, "x double, y double")
    got = {(r["x"], r["y"]): r["value"] for r in regrid.linear_between(source, target).collect()}
    for x, y in asked:
        inside = 0 <= x <= 10 and -2 <= y <= 0.5 and not (x > 4 and y > 0)
        assert got[x, y] == (pytest.approx(f(x, y)) if inside else None), (x, y)
    got = {(r["x"], r["y"]): r["value"] for r in regrid.nearest_between(source, target).collect()}
    near = lambda v, axis: None if not axis[0] <= v <= axis[-1] else max(a for a in axis if abs(a - v) == min(abs(b - v) for b in axis))
    cells = {(x, y): v for x, y, v in rows}
    assert all(got[x, y] == cells.get((near(x, xs), near(y, ys))) for x, y in asked) and got[2.5, -1.0] == cells[4.0, 0.0]
    edge = {(r["x"], r["y"]): r["value"] for r in regrid.nearest_between(source, target, outside=True).collect()}
    assert edge[-0.1, -3.0] == cells[0.0, -2.0] and edge[10.5, 0.3] is None
    even = spark.createDataFrame([(float(x), float(y), x * 5.0 + y) for x in range(4) for y in range(3)], "x double, y double, value double")
    same = lambda d: sorted(map(str, map(tuple, d.withColumn("value", F.round("value", 9)).collect())))
    assert same(regrid.linear_between(even, target)) == same(regrid.linear(even, target))


def test_agreement(spark):
    pairs = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 3.5), (None, 1.0)], "a double, b double")
    got = sensors.agreement(pairs).first()
    d = np.array([-0.5, 0, -0.5])
    assert got["n"] == 3 and got["bias"] == pytest.approx(d.mean(), abs=1e-6) and got["ubrmse"] == pytest.approx(d.std(), abs=1e-6) and got["r"] == pytest.approx(np.corrcoef([1, 2, 3], [1.5, 2, 3.5])[0, 1], abs=1e-4)
    flat = sensors.agreement(spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")).first()
    assert flat["r"] is None and flat["rmse"] == 1.0
    assert sensors.agreement(pairs.limit(2)).first()["bias"] is None
    assert [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1000.5,), (0.2,)], "v double").select(sensors.valid(F.col("v"))).collect()] == [None, None, None, 0.2]


def python_chunks(text):
    words, out, start = text.split(), [], 0
    while start < len(words):
        out.append(" ".join(words[start : start + 400]))
        if start + 400 >= len(words):
            break
        start += 320
    return [c for c in out if len(c) > 30]


def test_chunks(spark):
    docs = [(i, "s", " ".join(f"word{j}" for j in range(n))) for i, n in enumerate((0, 1, 3, 10, 399, 400, 401, 720, 721, 1500))] + [(50, "s", "no break and\ttabs  " * 30)]
    df = spark.createDataFrame(docs, "doc_id int, source string, text string")
    got = {}
    for r in retrieval.chunks(df).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: c for i, _, t in docs if (c := python_chunks(t))}


def test_text_functions(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one(T.source_key, "A_b-c  d.pdf") == "a b c d" and one(T.source_title, "soil_moisture.txt") == "Soil Moisture"
    assert one(T.base_name, "/a/b\\c.pdf") == "c.pdf" and one(T.named_files, "see /x/a.pdf and b.docx, a.pdf") == ["a.pdf", "b.docx"]
    assert [one(T.table_like, t) for t in ("a | b | c | d", "Table 3 shows", "a\tb\tc\td", "plain")] == [True, True, True, False]
    assert one(T.asset_type, "Figure 2 and table 3") == "table" and one(T.asset_number, "Figure 2 and table 3") == 3 and one(T.asset_number, "page 7") == 7
    assert one(T.citations, "x [Source: a.pdf] y [b.pdf] [a.pdf]") == ["a.pdf", "b.pdf"]
    assert one(T.sanitised, "'say `x`\" ") == "say x" and one(T.questions_of, "what is it? ok? tell me more") == ["what is it", "tell me more"]
    assert spark.range(1).select(T.fixed(F.lit(1.5), 3, True), T.file_uri(F.lit("/a")), T.table_text(F.array(F.array(F.lit("a"), F.lit(" b ")), F.array(F.lit("c"))))).first() == ("+1.500", "file:///a", "a | b\nc")


def test_whole_texts_are_sanitised(spark, tmp_path):
    from gridloam import queries

    texts = [None, " 'a` ", "x" * 300 + "'\"`" + " tail "]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["digest"], r["n_chars"]) for r in queries.QUERIES["text_sanitised"](spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.md5(c.encode()).hexdigest(), len(c)) for i, c in enumerate(["", "a", "x" * 300 + " tail"])}


def test_sources(spark):
    docs = spark.createDataFrame([("soil_moisture-trends.pdf",), ("soil_carbon.pdf",), ("soil_water.pdf",)], "source string")
    asked = spark.createDataFrame([(0, "in soil_carbon.pdf, what"), (1, "what do the trends say"), (2, "soil"), (3, "carbon and water")], "query_id int, text string")
    got = {r["query_id"]: r["source"] for r in retrieval.resolve_sources(asked, docs).collect()}
    assert got == {0: "soil_carbon.pdf", 1: "soil_moisture-trends.pdf", 2: None, 3: None}


def test_assets(spark):
    rows = [("a.pdf", "figure", 1, 1, "Soil map", "text"), ("a.pdf", "table", 2, 1, "Errors of retrieval", "bias"), ("b.pdf", "table", 2, 1, "Sites", ""), ("a.pdf", "figure", 3, 2, None, "moisture curve")]
    df = spark.createDataFrame(rows, "source string, type string, page int, idx int, caption string, page_text string").withColumn("text", F.lit("x | y"))
    names = lambda q: [(r["type"], r["idx"], r["source"]) for r in assets.relevant(df, q).collect()]
    assert names("explain figure 2") == [("figure", 2, "a.pdf")] and names("the retrieval errors") == [("table", 1, "a.pdf")] and names("moisture") == [("figure", 2, "a.pdf")] and names("zebra") == []
    # all of a number, of another type if need be; an asset that is named but not found gives none; the source counts as its caption does
    assert names("table 1") == [("table", 1, "a.pdf"), ("table", 1, "b.pdf")] and names("table 2") == [("figure", 2, "a.pdf")] and names("figure 9") == []
    assert names("on page 2") == [("table", 1, "a.pdf"), ("table", 1, "b.pdf")] and names("p. 3") == [("figure", 2, "a.pdf")]
    assert names("describe the figure about soil") == [] and names("the image of moisture") == []
    assert {n[2] for n in names("what does b.pdf explain")} == {"a.pdf", "b.pdf"} and names("what of b")[0] == ("table", 1, "b.pdf")
    assert len(names("what is it")) == 3 and names("what is it")[0] == ("figure", 1, "a.pdf")
    assert [r["sources"] for r in assets.collisions(df).collect()] == [2] and assets.by_number(df, "table", 1).count() == 1 and assets.capped(df).count() == 4
    assert assets.counts(df, spark.createDataFrame([("c.pdf",), ("a.pdf",)], "source string")).orderBy("source").collect()[1][1:] == (0, 0)
    assert assets.new_only(df, df.limit(1)).count() == 1 and retrieval.with_tables(df.select("source", "text"), df).count() == 6
    images = spark.createDataFrame([("doc_p3_img2.png",), ("fig_2-soil.png",), ("table03.png",), ("x_2.png",), ("soilmap_12.png",)], "name string")
    score = lambda q: {r["name"]: r["score"] for r in assets.ranked_images(images, q, 9).collect()}
    assert score("show figure 2") == {"doc_p3_img2.png": 15, "fig_2-soil.png": 15, "table03.png": 0, "x_2.png": 0, "soilmap_12.png": 0}
    assert score("table 3 of soil soil") == {"table03.png": 17, "fig_2-soil.png": 4, "soilmap_12.png": 4, "doc_p3_img2.png": 0, "x_2.png": 0}
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><td>b <b>c</b></td></tr><tr><td>1</td></tr></table><table><tr><td>x</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in assets.html_tables(pages).select("page_id", "idx", "text").collect()] == [(1, 1, "a | b c\n1")]


def test_verdicts(spark):
    rows = [("mean", 1, 0.0, 0.0, 0.0, 0.0, None, 0.0), ("mean", 9, 0.01, 0.01, 0.0, 0.01, 0.99999, 5e-5), ("max", 9, 1.0, 1.0, 0.0, 1.0, 0.5, 1.0), ("max", 0, None, None, None, None, None, None)]
    got = evaluation.verdict(spark.createDataFrame(rows, "op string, n int, bias double, rmse double, ubrmse double, mae double, r double, max_abs double"))
    assert [r["result"] for r in got.collect()] == ["PASS", "WARN", "FAIL", "SKIP"]
    total = evaluation.roll_up(got).where("op is null").first()
    assert (total["cases"], total["pass"], total["warn"], total["fail"], total["skip"]) == (4, 1, 1, 1, 1)
    assert evaluation.accuracy(spark.createDataFrame([("chat", "chat"), ("chat", "both")], "expected string, got string")).first()["accuracy"] == 0.5


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode())
    (tmp_path / "b.md").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"no")
    (tmp_path / "d.txt").write_bytes(b"  ")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "e.docx").write_bytes(raw.getvalue())
    got = {r["source"]: r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "café", "b.md": "naïve", "e.docx": "one\ntwo"}
    known = spark.createDataFrame([("a.txt",)], "source string")
    assert files.read_documents(spark, str(tmp_path), known).count() == 2


def test_grid_files(spark, tmp_path):
    rows = files.grid_rows(np.array([[1.0, float("nan")], [3.0, 4.0]]), 10.0, 0.5, 20.0, -0.5)
    rows["time"] = "2020-01-05"
    names = files.coordinate_names(["longitude", "Latitude"])
    assert names == {"lat": "Latitude", "lon": "longitude"}
    obs = files.long_grid(spark.createDataFrame(rows), "time", "y", "x", "value")
    assert obs.where("value is null").count() == 1 and sorted(r["x"] for r in obs.collect()) == [10.25, 10.25, 10.75, 10.75]
    files.write_observations(obs, str(tmp_path / "obs"))
    back = files.read_years(spark, str(tmp_path / "obs"), 2020, 2020)
    assert back.count() == 4 and grid.between(back, "2020-01-01", "2020-12-31").count() == 4
    plan = grid.between(back, "2020-01-01", "2020-12-31")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(FileNotFoundError):
        files.read_years(spark, str(tmp_path / "obs"), 2020, 2021)
    files.write_csv(obs, str(tmp_path / "csv"))


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", 1, 2.0), ("2024-01-01 23:00:00", 1, 4.0), ("2024-01-02 00:00:00", 1, 8.0), ("2024-01-09 00:00:00", 2, 1.0)]
    spark.createDataFrame(rows, "ts string, cell_id long, value double").select(F.to_timestamp("ts").alias("ts"), "cell_id", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, cell_id long, value double").parquet(str(tmp_path / "in"))
    q = daily_means(stream).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select * from daily").collect()) == [(date(2024, 1, 1), 1, 3.0, 2), (date(2024, 1, 2), 1, 8.0, 1)]


def test_index_grows_and_finds_what_a_search_does(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = retrieval.Index(spark, str(tmp_path / "index"), 8)
    half = docs.where("source < 'src2'")
    index.add(half).add(docs).add(docs)  # what is there already isn't added again
    assert index.totals().agg(F.sum("n_chunks")).first()[0] == retrieval.chunks(docs).count()
    again = retrieval.Index(spark, str(tmp_path / "index"), 8)
    for source in (None, "src3"):
        want = retrieval.search(retrieval.chunks(docs), asked, 3, "doc_id", "chunk_no", source=source)
        assert sorted(again.search(asked, 3, source).collect()) == sorted(want.collect())


def test_years_of_stores(tmp_path):
    import zipfile

    from gridloam.sources import zarr

    (tmp_path / "2020_v2.zarr").mkdir()
    with zipfile.ZipFile(tmp_path / "2021_v2.zarr.zip", "w") as z:
        z.writestr("2021_v2.zarr/.zgroup", "{}")
    assert zarr.year_store(str(tmp_path), 2020).endswith("2020_v2.zarr")
    assert os.path.exists(zarr.year_store(str(tmp_path), 2021) + "/.zgroup") and zarr.year_store(str(tmp_path), 2021).endswith(".zarr")
    with pytest.raises(FileNotFoundError):
        zarr.year_store(str(tmp_path), 2022)


def test_geojson_and_images(spark, tmp_path):
    import json

    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [{"properties": {"STATE": "One"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"STATE": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"properties": {}, "geometry": None}]
    (tmp_path / "r.geojson").write_text(json.dumps({"features": features}))
    got = {r["region"]: r["rings"] for r in files.geojson_regions(spark, str(tmp_path / "r.geojson"), to_degrees=lambda x, y: (x / 2, y)).collect()}
    assert set(got) == {"One", "Two"} and len(got["Two"]) == 2 and got["One"][0][1]["x"] == 1.0
    (tmp_path / "pics").mkdir()
    for n in ("a.PNG", "b.jpeg", "c.txt"):
        (tmp_path / "pics" / n).write_bytes(b"x")
    assert sorted(r["name"] for r in files.image_files(spark, str(tmp_path / "pics")).collect()) == ["a.PNG", "b.jpeg"]
    assert files.unique_name("png", "mean", "tamil nadu", None, 2).startswith("mean-tamil-nadu-2-") and files.unique_name("png") != files.unique_name("png")


def test_literature_answers(spark, tmp_path):
    from gridloam.operators import literature

    docs = spark.createDataFrame([(1, "soil_study.pdf", "soil moisture rises with rain " * 20), (2, "radar-notes.pdf", "radar echoes of bare fields " * 20)], "doc_id long, source string, text string")
    index = retrieval.Index(spark, str(tmp_path / "i"), 4).add(docs)
    found = spark.createDataFrame([("soil_study.pdf", "table", 3, 1, "Rain by month", "", "a | b"), ("radar-notes.pdf", "figure", 2, 1, "Echo power", "", "")], "source string, type string, page int, idx int, caption string, page_text string, text string")
    kind, rows = literature.answer(spark, "List all loaded files", index, found)
    assert kind == "list" and {(r["title"], r["chunks"], r["figures"], r["tables"]) for r in rows.collect()} == {("Soil Study", 1, 0, 1), ("Radar Notes", 1, 1, 0)}
    assert literature.answer(spark, "How many tables are there?", index, found)[1].agg(F.sum("tables")).first()[0] == 1
    kind, rows = literature.answer(spark, "Show me table 1", index, found)
    assert kind == "asset" and rows.first()["source"] == "soil_study.pdf"
    kind, rows = literature.answer(spark, "why does radar see bare fields", index, found)
    assert kind == "text" and rows.first()["source"] == "radar-notes.pdf"
    assert literature.command("load literature 'a/b.pdf'") == ("load", "a/b.pdf") and literature.command("Clear literature") == ("clear", "") and literature.command("tables of rain") is None


def test_commands(spark, tmp_path):
    from gridloam.operators.literature import Library

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "soil_study.txt").write_text("soil moisture rises with rain " * 20)
    (tmp_path / "in" / "radar-notes.md").write_text("radar echoes of bare fields " * 20)
    (tmp_path / "one.txt").write_text("")
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.run("what is soil") is None and lib.run("list literature")[1].count() == 0 and lib.run("tables")[1].count() == 0
    with pytest.raises(ValueError, match="path"):
        lib.run("load literature")
    lib.run(f"load literature {tmp_path}/one.txt")
    name, rows = lib.run(f"load literature '{tmp_path}/in'")
    assert name == "load" and {(r["source"], r["chunks"], r["tables"]) for r in rows.collect()} == {("soil_study.txt", 1, 0), ("radar-notes.md", 1, 0)}
    lib.run(f"load literature {tmp_path}/in")  # what is there already isn't loaded again
    assert lib.index.chunks().count() == 2
    lib.register(spark.createDataFrame([("soil_study.txt", "table", 1, 1, "Rain"), ("radar-notes.md", "figure", 2, 1, "Echoes"), ("soil_study.txt", "figure", 4, 2, None)], "source string, type string, page int, idx int, caption string"))
    lib.register(spark.createDataFrame([("soil_study.txt", "table", 9, 9, "again")], "source string, type string, page int, idx int, caption string"))
    assert [r["line"] for r in lib.run("list tables")[1].collect()] == ["Table 1 | p.1 | soil_study.txt: Rain"]
    assert lib.run("list images")[1].count() == 2 and [r["source"] for r in lib.run("vision images radar notes")[1].collect()] == ["radar-notes.md"]
    (tmp_path / "in" / "more.txt").write_text("rivers and lakes " * 20)
    assert lib.sync(str(tmp_path / "in")) == ["more.txt"] and lib.sync(str(tmp_path / "in")) == []
    assert lib.run("clear literature")[1].count() == 0 and lib.index.chunks().count() == 0


def test_question_kinds(spark):
    from gridloam.operators import literature

    rows = [("Explain the result of the test", True), ("see fig. 3", True), ("visualise it", True), ("soil of kerala", False), ("a configuration", False), ("what trend is there", True), (None, None)]
    got = spark.createDataFrame([(q,) for q, _ in rows], "q string").select("q", literature.visual(F.col("q")).alias("v")).collect()
    assert [(r["q"], r["v"]) for r in got] == rows


def test_index_of_nothing(spark, tmp_path):
    """An empty first batch, batches of other sources, and frequent terms in several shards."""
    kind = "doc_id int, source string, text string"
    index = retrieval.Index(spark, str(tmp_path / "i"), 4)
    asked = spark.createDataFrame([(0, "soil water"), (1, "nothing"), (2, "")], "query_id int, text string")
    assert index.search(asked, 3).count() == 0 and index.idf().count() == 0
    index.add(spark.createDataFrame([], kind))
    assert index.search(asked, 3).count() == 0 and index.chunks().count() == 0
    index.add(spark.createDataFrame([(1, "a", "soil water " * 50), (2, "a", "soil " * 60)], kind))
    assert [(r["doc_id"], r["rank"]) for r in index.search(asked, 3).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_index_of_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD_POSTINGS", 60)
    monkeypatch.setattr(retrieval, "CELLS", 16)
    import random

    rng = random.Random(2)
    words_ = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(rng.choices(words_, range(1, 41), k=rng.choice([20, 500])))) for i in range(60)] + [(60 + i, "s4", "w1 w2 " * 30) for i in range(5)], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words_, k=rng.randint(1, 12)))) for i in range(9)], "query_id int, text string")
    index = retrieval.Index(spark, str(tmp_path / "i"), 4).add(docs.where("source <> 's1'")).add(docs)
    assert index.postings().select("shard").distinct().count() > 5
    for source in (None, "s2"):
        want = retrieval.search(retrieval.chunks(docs), asked, 4, "doc_id", "chunk_no", source=source).collect()
        assert sorted(map(tuple, index.search(asked, 4, source).collect())) == sorted(map(tuple, want))
    monkeypatch.setattr(retrieval, "MOST_ASKED", 3)
    want = retrieval.search(retrieval.chunks(docs), asked, 4, "doc_id", "chunk_no").collect()
    assert sorted(map(tuple, index.search(asked, 4).collect())) == sorted(map(tuple, want))


def test_trends_of_regions_and_spans(spark):
    """Each region's and span's fit is that of a plan with this region and span alone."""
    from gridloam.plans.engine import Engine
    from gridloam.plans.query import Plan

    rows = [(date(2020, 1, 1) + timedelta(days=d), c, float(c), 0.0, (d * 7 % 11) / 3 + c * d / 50) for d in range(120) for c in range(4) if (d + c) % 5 and not (c == 3 and d > 40)]
    obs = spark.createDataFrame(rows, "obs_date date, cell_id long, x double, y double, value double")
    bridge = spark.createDataFrame([(0, "goa"), (1, "goa"), (2, "kerala"), (3, "punjab")], "cell_id long, region string")
    engine = Engine(spark, obs, bridge)
    spans = (("2020-01-05", "2020-02-20"), ("2020-03-01", "2020-04-15"))
    got = engine.execute(Plan("slope", ("goa", "kerala", "punjab"), spans))
    fits = {(r["region"], r["period_idx"]): r for r in got.scalars.collect()}
    assert len(fits) == 6 and fits["punjab", 1]["status"] == "no data" and fits["punjab", 1]["slope"] is None and fits["punjab", 1]["n"] == 0
    lines = got.days.groupBy("region", "period_idx").count().collect()
    assert {(r["region"], r["period_idx"]): r["count"] for r in lines} == {k: r["n"] for k, r in fits.items() if r["n"]}
    for (region, i), r in fits.items():
        if r["n"]:
            one = engine.execute(Plan("slope", (region,), (spans[i],))).scalars.first()
            for c in ("n", "first_day", "last_day", "direction"):
                assert r[c] == one[c]
            for c in ("slope", "intercept", "r2", "p_value", "total_change"):
                assert r[c] == pytest.approx(one[c], abs=1e-12)
    assert got.cells.where("region = 'goa' and period_idx = 0").count() == 2
    assert engine.execute(Plan("slope", ("goa", "punjab"), spans), strict=True).scalars.count() == 0


def test_daily_sums(spark, tmp_path):
    """An engine with stored sums gives what one without does; only years that have changed are made again."""
    from gridloam.operators.rollup import Rollup
    from gridloam.plans.engine import Engine
    from gridloam.plans.query import Plan

    rows = [(date(2019, 6, 1) + timedelta(days=d), c, float(c), 0.0, None if d % 9 == c else (d * 7 % 11) / 3 + c) for d in range(600) for c in range(4) if (d + c) % 5]
    obs = spark.createDataFrame(rows, OBS)
    bridge = spark.createDataFrame([(0, "goa"), (1, "goa"), (1, "kerala"), (2, "kerala"), (3, "punjab")], "cell_id long, region string")
    sums = Rollup(spark, f"file://{tmp_path}/sums")
    assert sums.days().count() == 0 and sums.refresh(obs.where("false"), bridge) == []
    assert sums.refresh(obs, bridge) == [2019, 2020, 2021] and sums.refresh(obs, bridge) == []

    def same(obs):
        plain, stored = Engine(spark, obs, bridge), Engine(spark, obs, bridge, sums=sums)
        assert plain.span() == stored.span()
        spans = (("2019-07-01", "2019-12-31"), ("2020-02-01", "2021-01-10"), ("2021-01-02", "2021-01-02"))
        plans = [Plan(op, (r,), spans[:1]) for op in ("mean", "minimum", "maximum") for r in ("goa", "india")]
        plans += [Plan("comparison", ("goa", "punjab", "india"), spans, m, "region") for m in ("mean", "min", "max", "slope")] + [Plan("coverage"), Plan("best_year", metric="max"), Plan("best_year", metric="min")]
        for p in plans:
            a, b = (sorted(map(tuple, e.execute(p).scalars.collect()), key=repr) for e in (plain, stored))
            assert len(a) == len(b), p
            for x, y in zip(a, b, strict=True):
                assert [round(v, 9) if isinstance(v, float) else v for v in x] == [round(v, 9) if isinstance(v, float) else v for v in y], p

    same(obs)
    other = obs.withColumn("value", F.when((F.col("obs_date") == "2020-05-05") & (F.col("cell_id") == 2), 99.0).otherwise(F.col("value"))).where("obs_date < '2021-01-01' or obs_date > '2021-01-05'")
    assert sums.refresh(other, bridge) == [2020, 2021]
    same(other)
    assert sums.refresh(other.where("year(obs_date) <> 2019"), bridge) == [2019]
    assert sums.days().where("year = 2019").count() == 0 and sums.days("2020-01-01", "2020-12-31").count() > 300


def test_regions_of_several_polygons(spark):
    """Rows of one region add up, overlapping regions both have a cell, and empty shapes are of no region."""
    ring = lambda x0, y0, x1, y1: [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    shapes = [("a", [ring(0.0, 0.0, 2.0, 2.0)]), ("A ", [ring(5.0, 0.0, 7.0, 2.0)]), ("b", [ring(1.0, 0.0, 6.0, 1.0)]), ("c", []), ("d", [[]])]
    cells = spark.createDataFrame([(i, i % 8 + 0.5, i // 8 + 0.5) for i in range(24)], "cell_id long, x double, y double")
    got = regions.bridge(cells, spark.createDataFrame(shapes, "region string, rings array<array<struct<x:double,y:double>>>")).collect()
    want = [(i, "a") for i in range(16) if i % 8 in (0, 1, 5, 6)] + [(i, "b") for i in range(1, 6)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_borders(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shapes = spark.createDataFrame([(" A ", [ring((0, 0), (0, 2), (2, 2)), ring((1, 1), (1, 1.5), (1, 1))]), ("b", [ring((5, 5))])], "region string, rings array<array<struct<x:double,y:double>>>")
    got = regions.borders(shapes).orderBy("ring", "no").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, 0.0, 0.0, 0.0, 2.0), ("a", 0, 1, 0.0, 2.0, 2.0, 2.0), ("a", 0, 2, 2.0, 2.0, 0.0, 0.0), ("a", 1, 0, 1.0, 1.0, 1.0, 1.5), ("a", 1, 1, 1.0, 1.5, 1.0, 1.0)]


def test_captions(spark):
    from gridloam.operators import captions

    page = "source string, page int, {} int, x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([("a", p, 1, 0.0, 300.0, 9.0, 400.0) for p in range(1, 9)], page.format("box"))
    at = lambda p, n, y0, text: ("a", p, n, 0.0, float(y0), 9.0, float(y0) + 10, text)
    blocks = spark.createDataFrame(
        [at(1, 9, 510, "Fig. 2 late"), at(1, 5, 520, "figure 3\nunder"), at(1, 1, 250, "Fig 1 over"), at(2, 1, 300, "Figure 7 over"), at(2, 2, 100.5, "Fig. 8 far"), at(3, 1, 599, "Fig. 4"), at(3, 2, 91, "Fig. 5"), at(4, 1, 600, "Fig. 6"),
         at(5, 1, 405, "a figure 3"), at(6, 3, 390, "  Fig.9  "), at(6, 2, 390, "Fig.10"), at(7, 1, 450, "Table 4: rain"), at(7, 2, 440, "table of rain " * 30), at(8, 1, 461, "Table 1")],
        page.format("block") + ", text string",
    )
    got = {r["page"]: (r["caption"], r["number"]) for r in captions.figure_captions(boxes, blocks).collect()}
    assert got == {1: ("figure 3 under", 3), 2: ("Figure 7 over", 7), 3: ("Fig. 4", 4), 4: (None, None), 5: (None, None), 6: ("Fig.10", 10), 7: (None, None), 8: (None, None)}
    got = {r["page"]: r["caption"] for r in captions.table_captions(boxes, blocks).collect()}
    assert got[7] == "Table 4: rain" and got[8] == "Table on page 8" and got[1] == "Table on page 1"


def test_splitting_and_refining():
    from gridloam.plans import intent
    from gridloam.plans.query import embedded_json, follow_up, parse, refined

    q = "mean moisture in kerala in 2020 and what does the algorithm in the paper do"
    assert intent.split_both(q) == (q, q)
    assert intent.split_both(q, lambda _: ("what does the algorithm in the paper do", "mean moisture in kerala in 2020")) == ("mean moisture in kerala in 2020", "what does the algorithm in the paper do")
    assert intent.split_both(q, lambda _: ("", "what does the algorithm in the paper do"))[0] == "mean moisture in kerala in 2020"
    assert intent.split_both(q, lambda _: ("mean moisture in kerala in 2020", ""))[1] == "what does the algorithm in the paper do"
    assert intent.split_both(q, lambda _: ("", "x")) == (q, q) and intent.split_both("soil of goa", lambda _: ("soil of goa", "")) == ("soil of goa", "soil of goa")
    three = "the mean of goa, the trend of kerala; and what the paper says of retrieval"
    assert intent.split_both(three, lambda _: (None, "what the paper says of retrieval"))[0] == "the mean of goa, the trend of kerala"
    assert intent.fast("himachal pradesh mean 2020") == "dataset" and intent.fast("hi there") == "chat" and "data: mean" in intent.explain("mean of goa")
    plan = parse("mean of kerala")
    assert plan.problem == "which dates?" and "Kerala" in follow_up(plan) and plan.patch("june 2020").problem is None
    assert "Which region" in follow_up(parse("mean in june 2020")) and follow_up(parse("mean of goa 2020")) is None
    assert embedded_json('so: {"a": {"b": 1}} end') == {"a": {"b": 1}} and embedded_json("none {x}") is None
    said = refined(plan, 'Sure! {"confident": true, "operation": "maximum", "region": "Goa", "start_date": "2021-01", "end_date": "2021-03"}')
    assert (said.operation, said.regions, said.spans, said.problem) == ("maximum", ("goa",), (("2021-01-01", "2021-03-31"),), None)
    assert refined(plan, '{"confident": false, "operation": "maximum"}') == plan
