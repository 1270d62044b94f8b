"""The registered queries of the engine, and for each the same answer in SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloam.functions import answers
from gridloam.functions import text as T
from gridloam.operators import assets, calendar, captions, compare, evaluation, gaps, grid, literature, pages, regions, regrid, retrieval, rollup, sensors, trend
from gridloam.plans import batch
from gridloam.plans import vocabulary as V
from gridloam.plans.engine import Engine
from gridloam.plans.query import Plan
from gridloam.sources import files, geotiff, pdf, png, shapefile, tables, zarr

REGION, START, END = "nation_3", "1996-06-01", "1996-06-30"
YEAR = ("1996-01-01", "1996-12-31")
SPANS = [("1995-01-01", "1995-12-31"), ("1996-06-01", "1997-05-31"), ("1997-01-01", "1997-12-31"), ("1990-01-01", "1990-12-31")]
TWO = ["nation_3", "nation_7"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OBS = """obs AS (SELECT CAST(l_shipdate AS DATE) AS obs_date, l_suppkey AS cell_id, l_suppkey % 10 AS x, l_suppkey // 10 AS y, avg(l_quantity) AS value FROM lineitem GROUP BY ALL),
bridge AS (SELECT s_suppkey AS cell_id, lower(trim(n_name)) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
SENSOR = """sensor AS (SELECT CAST(ts AS DATE) AS obs_date, user_id AS cell_id, CAST(user_id % 10 AS DOUBLE) AS x, CAST(user_id // 10 AS DOUBLE) AS y,
    avg(value) FILTER (hour(ts) < 12) AS am, avg(value) FILTER (hour(ts) >= 12) AS pm FROM events GROUP BY ALL)"""
CHUNKS = r"""words AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}\x{0085}]+'), lambda w: w <> '') AS w FROM documents),
chunks AS (SELECT doc_id, source, CAST(k AS INTEGER) AS chunk_no, array_to_string(w[k * 320 + 1 : k * 320 + 400], ' ') AS text
    FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((len(w) - 400) / 320), 0) AS BIGINT) + 1)) AS k FROM words WHERE len(w) > 0)),
kept AS (SELECT * FROM chunks WHERE length(text) > 30)"""
TFIDF = f"""{CHUNKS},
tok AS (SELECT source, doc_id, chunk_no, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM kept),
tf AS (SELECT source, doc_id, chunk_no, term, count(*) / any_value(n) AS tf FROM (SELECT source, doc_id, chunk_no, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM kept) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, term, count(*) / any_value(n) AS qf FROM (SELECT item_id, len(t) AS n, unnest(t) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)) GROUP BY ALL)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def regional(spark, sf, region=REGION, start=START, end=END) -> DataFrame:
    """The slice that most questions are about. Days are sliced below the aggregate that makes the grid."""
    return grid.in_region(grid.between(tables.observations(spark, sf), start, end), tables.cell_region(spark, sf), region)


SLICE = f"slice AS (SELECT * FROM obs WHERE obs_date BETWEEN DATE '{START}' AND DATE '{END}' AND cell_id IN (SELECT cell_id FROM bridge WHERE region = '{REGION}'))"
YEAR_SLICE = SLICE.replace(START, YEAR[0]).replace(END, YEAR[1])

for _metric, _sql in (("mean", "avg"), ("min", "min"), ("max", "max")):

    @query(f"scalar_{_metric}", f"WITH {OBS}, {SLICE} SELECT round({_sql}(value), 6) AS value, count(value) AS n_valid FROM slice")
    def _scalar(spark, sf, metric=_metric):
        return regional(spark, sf).agg(F.round(grid.reduce(metric), 6).alias("value"), F.count("value").alias("n_valid"))

    @query(f"cell_{_metric}_map", f"WITH {OBS}, {YEAR_SLICE} SELECT cell_id, x, y, round({_sql}(value), 6) AS value FROM slice GROUP BY ALL")
    def _map(spark, sf, metric=_metric):
        return grid.cell_map(regional(spark, sf, REGION, *YEAR), metric).withColumn("value", F.round("value", 6))

    @query(f"national_{_metric}", f"WITH {OBS} SELECT round({_sql}(value), 6) AS value, count(value) AS n_valid FROM obs WHERE obs_date BETWEEN DATE '{START}' AND DATE '{END}' AND cell_id IN (SELECT cell_id FROM bridge)")
    def _national(spark, sf, metric=_metric):
        return regional(spark, sf, grid.NATIONAL).agg(F.round(grid.reduce(metric), 6).alias("value"), F.count("value").alias("n_valid"))


@query(
    "missing_pct",
    f"""WITH {OBS}, {SLICE}, all_cells AS (SELECT cell_id, cell_id % 10 AS x, cell_id // 10 AS y, region FROM bridge),
    mine AS (SELECT * FROM all_cells WHERE region = '{REGION}'), box AS (SELECT count(*) AS region_cells, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mine),
    win AS (SELECT count(*) AS window_cells FROM all_cells, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
    SELECT n_valid, CAST(30 AS BIGINT) AS expected_days, region_cells, window_cells, round((1 - n_valid / (region_cells * 30)) * 100, 6) AS missing_pct_region, round((1 - n_valid / (window_cells * 30)) * 100, 6) AS missing_pct_window
    FROM (SELECT count(value) AS n_valid FROM slice), box, win""",
)
def missing_pct(spark, sf):
    cells = tables.cell_region(spark, sf).select("cell_id", "region", (F.col("cell_id") % 10).alias("x"), F.floor(F.col("cell_id") / 10).alias("y"))
    return grid.missing_share(regional(spark, sf), cells.where(F.col("region") == REGION), START, END, cells)


@query("region_series", f"WITH {OBS}, {YEAR_SLICE} SELECT obs_date, round(avg(value), 6) AS value FROM slice GROUP BY obs_date")
def region_series(spark, sf):
    return grid.series(regional(spark, sf, REGION, *YEAR)).withColumn("value", F.round("value", 6))


@query("region_summary", f"WITH {OBS} SELECT region, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(value) AS n_valid, count(*) AS n_rows, count(DISTINCT obs_date) AS n_days, count(DISTINCT cell_id) AS n_cells FROM obs JOIN bridge USING (cell_id) GROUP BY region")
def region_summary(spark, sf):
    return grid.summary(tables.observations(spark, sf).join(tables.cell_region(spark, sf), "cell_id"), "region").withColumn("mean", F.round("mean", 6))


_DAYS = "days AS (SELECT region, obs_date, avg(value) AS value, row_number() OVER (PARTITION BY region ORDER BY obs_date) - 1 AS idx FROM obs JOIN bridge USING (cell_id) GROUP BY region, obs_date)"
_TRENDS = """trends AS (SELECT region, count(*) AS n, min(obs_date) AS first_day, max(obs_date) AS last_day,
    CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(value, idx) END AS slope, CASE WHEN count(*) < 2 THEN avg(value) ELSE regr_intercept(value, idx) END AS intercept,
    CASE WHEN count(*) < 2 OR min(value) = max(value) THEN 0 ELSE regr_r2(value, idx) END AS r2 FROM days GROUP BY region)"""


def _trends(spark, sf):
    return trend.region_trend(tables.observations(spark, sf).join(tables.cell_region(spark, sf), "cell_id"), "region")


@query("region_trend", f"WITH {OBS}, {_DAYS}, {_TRENDS} SELECT region, n, first_day, last_day, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(slope * 2557, 6) AS total_change, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM trends")
def region_trend(spark, sf):
    out = trend.labelled(_trends(spark, sf), "1995-01-01", "2001-12-31")
    return out.select("region", "n", "first_day", "last_day", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("total_change", 6).alias("total_change"), "direction")


#: The p-value by Simpson's rule over the density of Student's t from 0 to |t|.
_P_VALUE = f"""WITH {OBS}, {_DAYS}, {_TRENDS}, s AS (SELECT region, n, n - 2 AS df, CASE WHEN n > 2 AND r2 < 1 THEN sqrt(r2 * (n - 2) / (1 - r2)) END AS t FROM trends),
k AS (SELECT unnest(range(0, 2001)) AS i),
f AS (SELECT region, sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(df + 1) / 2.0 * ln(1 + (t * i / 2000) ** 2 / df))) * any_value(t) / 6000 AS area FROM s, k WHERE t IS NOT NULL GROUP BY region)
SELECT region, n, round(CASE WHEN t IS NOT NULL THEN 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * area WHEN n > 2 THEN 0.0 ELSE 1.0 END, 8) AS p_value FROM s LEFT JOIN f USING (region)"""


@query("region_trend_p", _P_VALUE)
def region_trend_p(spark, sf):
    return trend.with_p_value(_trends(spark, sf)).select("region", "n", F.round("p_value", 8).alias("p_value"))


@query("trend_line", f"WITH {OBS}, {_DAYS}, {_TRENDS} SELECT region, obs_date, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value, round(intercept + slope * idx, 6) AS fitted FROM days JOIN trends USING (region) WHERE region = '{REGION}'")
def trend_line(spark, sf):
    obs = tables.observations(spark, sf).join(tables.cell_region(spark, sf).where(F.col("region") == REGION), "cell_id")
    return trend.trend_line(obs, "region").withColumn("value", F.round("value", 6)).withColumn("fitted", F.round("fitted", 6))


@query("cell_slope_map", f"WITH {OBS}, {YEAR_SLICE}, d AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1 AS idx FROM (SELECT DISTINCT obs_date FROM slice)) SELECT cell_id, x, y, CASE WHEN count(value) >= 3 THEN round(regr_slope(value, idx), 8) END AS value, count(value) AS n FROM slice JOIN d USING (obs_date) GROUP BY cell_id, x, y")
def cell_slope_map(spark, sf):
    return trend.cell_trend(regional(spark, sf, REGION, *YEAR)).withColumn("value", F.round("value", 8))


_PERIODS = "periods AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(SPANS)) + ") t(period_idx, period_start, period_end))"
_PHITS = f"hits AS (SELECT period_idx, obs_date, cell_id, value FROM obs JOIN periods ON obs_date BETWEEN period_start AND period_end WHERE cell_id IN (SELECT cell_id FROM bridge WHERE region = '{REGION}'))"
_RANK = {"mean": "value", "max": "value", "min": "-value", "slope": "abs(value)"}
for _metric in grid.METRICS:
    if _metric == "slope":
        _got = "got AS (SELECT period_idx, CASE WHEN count(*) >= 3 THEN regr_slope(value, idx) END AS value, count(*) AS n FROM (SELECT period_idx, avg(value) AS value, row_number() OVER (PARTITION BY period_idx ORDER BY obs_date) - 1 AS idx FROM hits GROUP BY period_idx, obs_date) GROUP BY period_idx)"
    else:
        _got = f"got AS (SELECT period_idx, {'avg' if _metric == 'mean' else _metric}(value) AS value, count(value) AS n FROM hits GROUP BY period_idx)"

    @query(
        f"compare_periods_{_metric}",
        f"WITH {OBS}, {_PERIODS}, {_PHITS}, {_got} SELECT period_idx, period_start, period_end, round(value, 8) AS value, coalesce(n, 0) AS n, value IS NOT NULL AND row_number() OVER (ORDER BY {_RANK[_metric]} DESC NULLS LAST, period_idx) = 1 AS winner FROM periods LEFT JOIN got USING (period_idx)",
    )
    def _periods(spark, sf, metric=_metric):
        obs = regional(spark, sf, REGION, *compare.hull(SPANS))
        return compare.compare_periods(obs, compare.periods(spark, SPANS), metric).withColumn("value", F.round("value", 8))


@query("compare_regions", f"WITH {OBS}, got AS (SELECT region, avg(value) AS value, count(value) AS n FROM obs JOIN bridge USING (cell_id) WHERE region IN ('nation_3', 'nation_7') AND obs_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}' GROUP BY region), i AS (SELECT region, region_idx, value, coalesce(n, 0) AS n FROM (VALUES (CAST(0 AS INTEGER), 'nation_3'), (CAST(1 AS INTEGER), 'nation_7')) t(region_idx, region) LEFT JOIN got USING (region)) SELECT region, round(value, 6) AS value, n, region_idx, value IS NOT NULL AND row_number() OVER (ORDER BY value DESC NULLS LAST, region_idx) = 1 AS winner FROM i")
def compare_regions(spark, sf):
    obs = grid.between(tables.observations(spark, sf), *YEAR)
    return compare.compare_regions(obs, tables.cell_region(spark, sf), TWO, "mean").withColumn("value", F.round("value", 6))


@query("multi_range_mean", f"WITH {OBS}, {_PERIODS}, {_PHITS} SELECT period_idx, round(avg(value), 6) AS value, count(value) AS n FROM hits GROUP BY period_idx")
def multi_range_mean(spark, sf):
    obs = regional(spark, sf, REGION, *compare.hull(SPANS))
    return compare.metric_of(compare.by_period(obs, compare.periods(spark, SPANS)), "mean", "period_idx").withColumn("value", F.round("value", 6))


_MEANS = "means AS (SELECT region, avg(value) AS mean FROM obs JOIN bridge USING (cell_id) GROUP BY region)"


@query("region_ranking", f"WITH {OBS}, {_MEANS} SELECT region, round(mean, 6) AS mean, 'driest' AS side FROM (SELECT * FROM means ORDER BY mean, region LIMIT 3) UNION ALL SELECT region, round(mean, 6), 'wettest' FROM (SELECT * FROM means ORDER BY mean DESC, region LIMIT 3)")
def region_ranking(spark, sf):
    return grid.ranking(tables.observations(spark, sf), tables.cell_region(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("all_region_stats", f"WITH {OBS} SELECT region, round(avg(value), 5) AS value FROM obs JOIN bridge USING (cell_id) GROUP BY region")
def all_region_stats(spark, sf):
    return grid.all_regions(tables.observations(spark, sf), tables.cell_region(spark, sf))


@query("yearly_national_argmax", f"WITH {OBS} SELECT CAST(year(obs_date) AS INTEGER) AS year, round(avg(value), 6) AS mean FROM obs GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 1")
def yearly_national_argmax(spark, sf):
    return grid.best_year(tables.observations(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("coverage_kpis", f"WITH {OBS} SELECT min(obs_date) AS first_day, max(obs_date) AS last_day, count(DISTINCT obs_date) AS n_days, round(avg(value), 6) AS mean, (SELECT count(DISTINCT region) FROM bridge) AS n_regions, CAST(max(obs_date) - min(obs_date) + 1 AS BIGINT) AS span_days FROM obs")
def coverage_kpis(spark, sf):
    return grid.coverage(tables.observations(spark, sf), tables.cell_region(spark, sf))


@query("colour_scale", f"WITH {OBS}, {YEAR_SLICE}, m AS (SELECT avg(value) AS value FROM slice GROUP BY cell_id) SELECT round(min(value), 6) AS vmin, round(max(value), 6) AS vmax FROM m")
def colour_scale(spark, sf):
    return grid.colour_scale(grid.cell_map(regional(spark, sf, REGION, *YEAR), "mean")).select(F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


_LABEL = {"day": "first", "week": "first + 6", "month": "last_day(first)", "quarter": "last_day(CAST(first + INTERVAL 2 MONTH AS DATE))", "year": "last_day(CAST(first + INTERVAL 11 MONTH AS DATE))"}
_STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}
for _grain in calendar.STEPS:

    @query(
        f"resample_{_grain}",
        f"""WITH {OBS}, d AS (SELECT region, obs_date, avg(value) AS value FROM obs JOIN bridge USING (cell_id) WHERE region IN ('nation_3', 'nation_7') GROUP BY ALL),
        b AS (SELECT region, CAST(date_trunc('{_grain}', obs_date) AS DATE) AS first, avg(value) AS value FROM d GROUP BY ALL),
        spine AS (SELECT region, CAST(unnest(generate_series(CAST(min(first) AS TIMESTAMP), CAST(max(first) AS TIMESTAMP), INTERVAL {_STEP[_grain]})) AS DATE) AS first FROM b GROUP BY region)
        SELECT region, CAST({_LABEL[_grain]} AS DATE) AS bucket, round(value, 6) AS value FROM spine LEFT JOIN b USING (region, first)""",
    )
    def _resample(spark, sf, grain=_grain):
        obs = tables.observations(spark, sf).join(tables.cell_region(spark, sf).where(F.col("region").isin(TWO)), "cell_id")
        return calendar.resample(grid.series(obs, "region"), grain).withColumn("value", F.round("value", 6))


_DAILY = f"d AS (SELECT obs_date, avg(value) AS value FROM obs WHERE cell_id IN (SELECT cell_id FROM bridge WHERE region = '{REGION}') GROUP BY obs_date)"
for _metric, _sql in (("mean", "avg"), ("min", "min"), ("max", "max")):

    @query(f"year_month_{_metric}", f"WITH {OBS}, {_DAILY} SELECT CAST(year(obs_date) AS INTEGER) AS year, CAST(month(obs_date) AS INTEGER) AS month, round({_sql}(value), 6) AS value FROM d GROUP BY ALL")
    def _year_month(spark, sf, metric=_metric):
        return calendar.year_month(grid.series(regional(spark, sf, REGION, None, None)), metric).withColumn("value", F.round("value", 6))


@query("season_heatmap", f"WITH {OBS}, {_DAILY} SELECT CAST(year(obs_date) AS INTEGER) AS year, " + ", ".join(f"round(avg(value) FILTER (month(obs_date) = {m}), 6) AS m{m}" for m in range(1, 13)) + " FROM d GROUP BY 1")
def season_heatmap(spark, sf):
    out = calendar.heatmap(grid.series(regional(spark, sf, REGION, None, None)))
    return out.select("year", *[F.round(f"m{m}", 6).alias(f"m{m}") for m in range(1, 13)])


_GONE = f"gone AS (SELECT day FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{YEAR[0]}', TIMESTAMP '{YEAR[1]}', INTERVAL 1 DAY)) AS DATE) AS day) WHERE day NOT IN (SELECT obs_date FROM slice))"


@query("missing_periods", f"WITH {OBS}, {YEAR_SLICE}, {_GONE} SELECT min(day) AS run_start, max(day) AS run_end, count(*) AS n_days FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM gone) GROUP BY island")
def missing_periods(spark, sf):
    return gaps.runs(gaps.missing_days(spark, regional(spark, sf, REGION, *YEAR), *YEAR))


@query("missing_report", f"WITH {OBS}, {YEAR_SLICE}, {_GONE} SELECT CAST(366 AS BIGINT) AS total_expected, (SELECT count(*) FROM gone) AS total_missing, count(DISTINCT obs_date) AS total_available, round((SELECT count(*) FROM gone) / 366 * 100, 6) AS missing_pct, coalesce((SELECT string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) FROM (SELECT day FROM gone ORDER BY day LIMIT 10)), '') AS first_missing, min(obs_date) AS first_available, max(obs_date) AS last_available, (SELECT count(*) FROM gone) / 366 > 0.25 AS flagged FROM slice")
def missing_report(spark, sf):
    return gaps.report(spark, regional(spark, sf, REGION, *YEAR), *YEAR)


#: To six places, from twelve: the last bits of a sum don't decide.
_SIX = "CAST(round(CAST(avg({b}) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS {b}"


@query("sensor_series", f"WITH {SENSOR} SELECT obs_date, {_SIX.format(b='am')} FROM sensor WHERE x BETWEEN 2 AND 7 AND y BETWEEN 1 AND 9 GROUP BY obs_date HAVING count(am) > 0")
def sensor_series(spark, sf):
    return sensors.band_series(grid.in_box(tables.sensor(spark, sf), 2, 1, 7, 9), "am")


@query("sensor_multiband", f"WITH {SENSOR} SELECT obs_date, {_SIX.format(b='am')}, {_SIX.format(b='pm')} FROM sensor GROUP BY obs_date HAVING count(am) > 0 OR count(pm) > 0")
def sensor_multiband(spark, sf):
    return sensors.band_series(tables.sensor(spark, sf), "am", "pm")


_GRID = "g_{b} AS (SELECT x, y, CASE WHEN avg({b}) > 0 AND avg({b}) <= 1000 THEN avg({b}) END AS value FROM sensor WHERE obs_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY x, y)"
_GRIDS = f"{SENSOR}, {_GRID.format(b='am')}, {_GRID.format(b='pm')}"
_PAIRS = "pairs AS (SELECT x, y, a.value AS a, b.value AS b FROM g_am a FULL JOIN g_pm b USING (x, y))"


def _grids(spark, sf):
    obs = grid.between(tables.sensor(spark, sf), "2024-01-05", "2024-01-20")
    return sensors.period_grid(obs, "am"), sensors.period_grid(obs, "pm")


@query("sensor_grid", f"WITH {_GRIDS} SELECT x, y, round(value, 6) AS value FROM g_am")
def sensor_grid(spark, sf):
    return _grids(spark, sf)[0].withColumn("value", F.round("value", 6))


@query("sensor_grid_summary", f"WITH {_GRIDS} SELECT round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n_cells, (SELECT count(DISTINCT obs_date) FROM sensor WHERE am IS NOT NULL AND obs_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS n_images FROM g_am")
def sensor_grid_summary(spark, sf):
    obs = grid.between(tables.sensor(spark, sf), "2024-01-05", "2024-01-20")
    return sensors.grid_summary(obs, "am").select(*[F.round(c, 6).alias(c) for c in ("mean", "min", "max")], "n_cells", "n_images")


@query("bias_grid", f"WITH {_GRIDS}, {_PAIRS} SELECT x, y, round(a - b, 8) AS value FROM pairs")
def bias_grid(spark, sf):
    return sensors.bias_grid(*_grids(spark, sf)).withColumn("value", F.round("value", 8))


@query("sensor_metrics", f"WITH {_GRIDS}, {_PAIRS}, d AS (SELECT a, b, a - b AS d FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rmse, round(sqrt(var_pop(d)), 6) AS ubrmse, round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS max_abs, round(corr(a, b), 4) AS r, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(corr(a, b) ** 2, 4) AS r2 FROM d")
def sensor_metrics(spark, sf):
    return sensors.agreement(sensors.paired(*_grids(spark, sf)))


@query("grid_percentiles", f"WITH {_GRIDS}, {_PAIRS} SELECT (SELECT round(quantile_cont(value, 0.98), 6) FROM g_am) AS p98, (SELECT round(quantile_cont(abs(a - b), 0.95), 6) FROM pairs) AS bias_p95")
def grid_percentiles(spark, sf):
    am, pm = _grids(spark, sf)
    p98 = sensors.percentile(am, 0.98).select(F.round("value", 6).alias("p98"))
    return p98.join(sensors.percentile(sensors.bias_grid(am, pm), 0.95, F.abs("value")).select(F.round("value", 6).alias("bias_p95")))


@query(
    "regrid_linear",
    f"""WITH {_GRIDS}, t AS (SELECT DISTINCT x + 0.25 AS x, y + 0.5 AS y FROM sensor),
    c AS (SELECT t.x, t.y, floor(t.x) + a.o AS i, floor(t.y) + b.o AS j, (CASE a.o WHEN 1 THEN 0.25 ELSE 0.75 END) * 0.5 AS w FROM t, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o))
    SELECT c.x, c.y, CASE WHEN count(value) = 4 THEN round(CAST(sum(w * value) AS DOUBLE), 6) END AS value FROM c LEFT JOIN g_am g ON g.x = c.i AND g.y = c.j GROUP BY c.x, c.y""",
)
def regrid_linear(spark, sf):
    target = tables.sensor(spark, sf).select((F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y")).distinct()
    return regrid.linear(_grids(spark, sf)[0], target).withColumn("value", F.round("value", 6))


@query("regrid_nearest", f"WITH {_GRIDS}, t AS (SELECT DISTINCT x + 0.25 AS x, y - 0.375 AS y FROM sensor) SELECT t.x, t.y, round(value, 6) AS value FROM t LEFT JOIN g_pm g ON g.x = floor(t.x + 0.5) AND g.y = floor(t.y + 0.5)")
def regrid_nearest(spark, sf):
    target = tables.sensor(spark, sf).select((F.col("x") + 0.25).alias("x"), (F.col("y") - 0.375).alias("y")).distinct()
    return regrid.nearest(_grids(spark, sf)[1], target).withColumn("value", F.round("value", 6))


@query("chunk_docs", f"WITH {CHUNKS} SELECT doc_id, source, chunk_no, length(text) AS n_chars, md5(text) AS digest FROM kept")
def chunk_docs(spark, sf):
    return retrieval.chunks(tables.documents(spark, sf)).select("doc_id", "source", "chunk_no", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("tfidf_idf", f"WITH {TFIDF} SELECT term, df, round(idf, 8) AS idf FROM idf")
def tfidf_idf(spark, sf):
    return index_of(spark, sf).idf().select("term", "df", F.round("idf", 8).alias("idf"))


_indexes: dict[tuple, retrieval.Index] = {}


def index_of(spark, sf) -> retrieval.Index:
    """The stored index of a folder's documents, built when it is first asked for in a session, or when they have changed."""
    key = (spark.sparkContext.applicationId, sf, tables.stamp(spark, sf, "documents"))
    if key not in _indexes:
        _indexes[key] = retrieval.Index(spark, f"{tables.scratch(spark)}/index-{uuid.uuid4().hex}").add(tables.documents(spark, sf))
    return _indexes[key]


_SCORES = "s AS (SELECT query_id, source, doc_id, chunk_no, sum(tf * qf * idf * idf) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term) WHERE {w} GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS INTEGER) AS rank FROM s WHERE score > 0) SELECT query_id, rank, source, doc_id, chunk_no, round(score, 6) AS score FROM r WHERE rank <= {k}"


@query("tfidf_topk_unindexed", f"WITH {TFIDF}, {_SCORES.format(w='true', k=3)}")
def tfidf_topk_unindexed(spark, sf):
    """The same search straight from the texts."""
    return retrieval.search(retrieval.chunks(tables.documents(spark, sf)), tables.questions(spark, sf), 3, "doc_id", "chunk_no")


@query("tfidf_topk", f"WITH {TFIDF}, {_SCORES.format(w='true', k=3)}")
def tfidf_topk(spark, sf):
    return index_of(spark, sf).search(tables.questions(spark, sf), 3)


_FROM_SOURCE = "source = 'src3'"


@query("tfidf_topk_source", f"WITH {TFIDF}, {_SCORES.format(w=_FROM_SOURCE, k=3)}")
def tfidf_topk_source(spark, sf):
    return index_of(spark, sf).search(tables.questions(spark, sf), 3, "src3")


_CONTEXT = _SCORES.format(w="true", k=3).replace("SELECT query_id, rank, source, doc_id, chunk_no, round(score, 6) AS score FROM r WHERE rank <= 3", "SELECT query_id, md5(left(string_agg('[' || r.source || '] ' || kept.text, '\n\n' ORDER BY rank), 3000)) AS digest FROM r JOIN kept USING (doc_id, chunk_no) WHERE rank <= 3 GROUP BY query_id")


@query("retrieval_context", f"WITH {TFIDF}, {_CONTEXT}")
def retrieval_context(spark, sf):
    index = index_of(spark, sf)
    return retrieval.context(index.search(tables.questions(spark, sf), 3), index.chunks(), "doc_id", "chunk_no").select("query_id", F.md5("context").alias("digest"))


@query(
    "source_resolve",
    """WITH q AS (SELECT * FROM (VALUES (0, 'what does src3 say about yields'), (1, 'compare src11 with others'), (2, 'no name here'), (3, 'SRC7.pdf please')) t(query_id, text)),
    names AS (SELECT DISTINCT source, lower(source) AS name FROM documents),
    hit AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, source DESC) AS k FROM q JOIN names ON contains(lower(text), name))
    SELECT CAST(q.query_id AS INTEGER) AS query_id, hit.source FROM q LEFT JOIN hit ON q.query_id = hit.query_id AND k = 1""",
)
def source_resolve(spark, sf):
    asked = spark.createDataFrame([(0, "what does src3 say about yields"), (1, "compare src11 with others"), (2, "no name here"), (3, "SRC7.pdf please")], "query_id int, text string")
    return retrieval.resolve_sources(asked, tables.documents(spark, sf))


@query("table_like_count", f"WITH {CHUNKS} SELECT source, count(*) AS n_chunks, count(*) FILTER (length(text) - length(replace(text, '|', '')) >= 3 OR length(text) - length(replace(text, '\t', '')) >= 3 OR regexp_matches(text, '(?i)\\bTable\\s+\\d+')) AS n_tables FROM kept GROUP BY source")
def table_like_count(spark, sf):
    return retrieval.table_counts(retrieval.chunks(tables.documents(spark, sf)))


@query("asset_keywords", "SELECT item_id AS query_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in assets.STOP_WORDS) + "], w)))), ' ') AS words FROM benchmark")
def asset_keywords(spark, sf):
    return tables.questions(spark, sf).select("query_id", F.array_join(F.array_sort(assets.keywords(F.col("text"))), " ").alias("words"))


@query("text_sanitised", "SELECT doc_id, md5(clean) AS digest, length(clean) AS n_chars, len(list_filter(list_transform(string_split(text, '?'), lambda p: trim(p)), lambda p: length(p) >= 5)) AS parts FROM (SELECT doc_id, trim(translate(coalesce(text, ''), '\"''`', '')) AS clean, coalesce(text, '') AS text FROM documents)")
def text_sanitised(spark, sf):
    """Whole texts cleaned, and how many questions they hold."""
    clean = T.sanitised(F.col("text"))
    return tables.documents(spark, sf).select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n_chars"), F.size(T.questions_of(F.col("text"))).cast("long").alias("parts"))


def values(rows, names: str) -> str:
    """Rows as a table in SQL."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


# -- questions, plans and the engine


THREE = [*TWO, "nation_99"]
_TRIO = "regions AS (SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'nation_3'), (CAST(1 AS INTEGER), 'nation_7'), (CAST(2 AS INTEGER), 'nation_99')) t(region_idx, region))"
_CROSS = f"{_PERIODS}, {_TRIO}, hit AS (SELECT region, period_idx, value, obs_date FROM obs JOIN bridge USING (cell_id) JOIN periods ON obs_date BETWEEN period_start AND period_end)"
_CELLS = "cells AS (SELECT r.*, p.*, g.value, coalesce(g.n, 0) AS n FROM regions r CROSS JOIN periods p LEFT JOIN got g USING (region, period_idx))"
for _metric, _sql in (("mean", "avg"), ("min", "min"), ("max", "max")):

    @query(
        f"compare_regions_periods_{_metric}",
        f"WITH {OBS}, {_CROSS}, got AS (SELECT region, period_idx, {_sql}(value) AS value, count(value) AS n FROM hit GROUP BY ALL), {_CELLS} SELECT region_idx, region, period_idx, period_start, period_end, round(value, 8) AS value, n, CASE WHEN value IS NULL THEN 'no data' ELSE 'ok' END AS status, value IS NOT NULL AND row_number() OVER (PARTITION BY period_idx ORDER BY {_RANK[_metric]} DESC NULLS LAST, region_idx) = 1 AS winner FROM cells",
    )
    def _regions_periods(spark, sf, metric=_metric):
        """Several regions over several periods, those without data too."""
        obs = grid.between(tables.observations(spark, sf), *compare.hull(SPANS))
        return compare.regions_by_period(obs, tables.cell_region(spark, sf), THREE, compare.periods(spark, SPANS), metric).withColumn("value", F.round("value", 8))


@query("compare_regions_missing", f"WITH {OBS}, {_TRIO}, got AS (SELECT region, avg(value) AS value, count(value) AS n FROM obs JOIN bridge USING (cell_id) WHERE obs_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}' GROUP BY region) SELECT region, round(value, 6) AS value, coalesce(n, 0) AS n, region_idx, value IS NOT NULL AND row_number() OVER (ORDER BY value DESC NULLS LAST, region_idx) = 1 AS winner FROM regions LEFT JOIN got USING (region)")
def compare_regions_missing(spark, sf):
    obs = grid.between(tables.observations(spark, sf), *YEAR)
    return compare.compare_regions(obs, tables.cell_region(spark, sf), THREE, "mean").withColumn("value", F.round("value", 6))


for _name, _spans in (("complete", SPANS[:3]), ("incomplete", SPANS)):

    @query(
        f"compare_strict_{_name}",
        f"WITH {OBS}, {_PERIODS}, {_PHITS}, got AS (SELECT period_idx, avg(value) AS value, count(value) AS n FROM hits GROUP BY period_idx), every AS (SELECT * FROM periods LEFT JOIN got USING (period_idx) WHERE period_idx < {len(_spans)}) SELECT period_idx, period_start, period_end, round(value, 8) AS value, n, row_number() OVER (ORDER BY value DESC NULLS LAST, period_idx) = 1 AS winner FROM every WHERE (SELECT min(coalesce(n, 0)) FROM every) > 0",
    )
    def _strict(spark, sf, spans=_spans):
        """All periods, or nothing if one of them is empty."""
        obs = regional(spark, sf, REGION, *compare.hull(spans))
        return compare.complete(compare.compare_periods(obs, compare.periods(spark, spans), "mean")).withColumn("value", F.round("value", 8))


def _engine(spark, sf) -> Engine:
    nations = regions.catalogue(tables.table(spark, sf, "nation").withColumnRenamed("n_name", "region"))
    known = [r["region"] for r in nations.collect()]  # also those that no cell lies in
    return Engine(spark, tables.observations(spark, sf), tables.cell_region(spark, sf), known)


@query("multi_region_mean", f"WITH {OBS}, {_TRIO}, got AS (SELECT region, avg(value) AS value, count(value) AS n FROM obs JOIN bridge USING (cell_id) WHERE obs_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}' GROUP BY region) SELECT region, DATE '{YEAR[0]}' AS period_start, DATE '{YEAR[1]}' AS period_end, round(value, 6) AS value, coalesce(n, 0) AS n, CASE WHEN value IS NULL THEN 'no data' ELSE 'ok' END AS status FROM regions LEFT JOIN got USING (region) WHERE region_idx < 2")
def multi_region_mean(spark, sf):
    """A plan with two regions answers for both."""
    got = _engine(spark, sf).execute(Plan("mean", tuple(TWO), (YEAR,))).scalars
    return got.select("region", "period_start", "period_end", F.round("value", 6).alias("value"), "n", "status")


@query("engine_whole_archive", f"WITH {OBS} SELECT round(avg(value), 6) AS value, count(value) AS n_valid, count(DISTINCT obs_date) AS n_days, 'ok' AS status FROM obs WHERE cell_id IN (SELECT cell_id FROM bridge)")
def engine_whole_archive(spark, sf):
    """A span outside the data, with all days standing in."""
    plan = Plan("mean", (grid.NATIONAL,), (("2050-01-01", "2050-12-31"),))
    return _engine(spark, sf).execute(plan, whole_if_outside=True).scalars.withColumn("value", F.round("value", 6))


_RANGES = [("1996-06", "1996-07"), ("1990-01-01", "1990-12-31"), ("1997-12-31", "1997-01-01")]
_BATCH = "periods AS (SELECT * FROM (VALUES (CAST(0 AS INTEGER), DATE '1996-06-01', DATE '1996-07-31'), (CAST(1 AS INTEGER), DATE '1990-01-01', DATE '1990-12-31'), (CAST(2 AS INTEGER), DATE '1997-01-01', DATE '1997-12-31')) t(period_idx, period_start, period_end))"


@query("engine_batch", f"WITH {OBS}, {_BATCH}, got AS (SELECT period_idx, max(value) AS value, count(value) AS n FROM obs JOIN periods ON obs_date BETWEEN period_start AND period_end WHERE cell_id IN (SELECT cell_id FROM bridge WHERE region = '{REGION}') GROUP BY period_idx) SELECT '{REGION}' AS region, period_idx, period_start, period_end, round(value, 6) AS value, coalesce(n, 0) AS n, CASE WHEN value IS NULL THEN 'no data' ELSE 'ok' END AS status FROM periods LEFT JOIN got USING (period_idx)")
def engine_batch(spark, sf):
    return _engine(spark, sf).batch(REGION, _RANGES, "maximum").withColumn("value", F.round("value", 6))


@query("ranking_by_period", f"WITH {OBS}, {_PERIODS}, m AS (SELECT period_idx, region, avg(value) AS mean FROM obs JOIN bridge USING (cell_id) JOIN periods ON obs_date BETWEEN period_start AND period_end GROUP BY ALL) SELECT period_idx, region, round(mean, 6) AS mean, 'driest' AS side FROM m QUALIFY row_number() OVER (PARTITION BY period_idx ORDER BY mean, region) <= 3 UNION ALL SELECT period_idx, region, round(mean, 6), 'wettest' FROM m QUALIFY row_number() OVER (PARTITION BY period_idx ORDER BY mean DESC, region) <= 3")
def ranking_by_period(spark, sf):
    within = compare.by_period(grid.between(tables.observations(spark, sf), *compare.hull(SPANS)), compare.periods(spark, SPANS))
    return grid.ranking(within, tables.cell_region(spark, sf), 3, "period_idx").withColumn("mean", F.round("mean", 6))


@query("box_slice", f"WITH {OBS} SELECT count(*) AS n, round(avg(value), 6) AS mean FROM obs WHERE x BETWEEN 2 AND 5 AND y BETWEEN 0 AND 3 AND obs_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'")
def box_slice(spark, sf):
    return grid.in_box(grid.between(tables.observations(spark, sf), *YEAR), 2, 0, 5, 3).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("series_missing_pct", f"WITH {SENSOR}, d AS (SELECT obs_date, avg(am) FILTER (x < 3) AS value FROM sensor GROUP BY obs_date) SELECT count(*) AS n_days, count(*) FILTER (value IS NULL) AS n_missing, round(count(*) FILTER (value IS NULL) / count(*) * 100, 6) AS missing_pct FROM d")
def series_missing_pct(spark, sf):
    obs = tables.sensor(spark, sf).withColumn("value", F.when(F.col("x") < 3, F.col("am")))
    return grid.series_missing(grid.series(obs))


@query("missing_periods_text", f"WITH {OBS}, {YEAR_SLICE}, {_GONE}, runs AS (SELECT min(day) AS a, max(day) AS b FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM gone) GROUP BY island), t AS (SELECT a, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || ' to ' || CAST(b AS VARCHAR) END AS t FROM runs) SELECT coalesce((SELECT string_agg(t, ', ' ORDER BY a) FROM (SELECT * FROM t ORDER BY a LIMIT 5)), '') || CASE WHEN (SELECT count(*) FROM t) > 5 THEN ' + ' || CAST((SELECT count(*) FROM t) - 5 AS VARCHAR) || ' more' ELSE '' END AS periods")
def missing_periods_text(spark, sf):
    return gaps.described(gaps.runs(gaps.missing_days(spark, regional(spark, sf, REGION, *YEAR), *YEAR)))


# -- polygons, maps, files

_SQUARE = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
_RINGS = [("Holed ", [_SQUARE(0, 0, 4, 4), _SQUARE(1, 1, 3, 3)]), ("Beside", [_SQUARE(4, 0, 8, 4)]), ("Bent", [[(0, 4), (8, 4), (8, 6), (2, 6), (2, 9), (0, 9)]])]


@query("cell_bridge", f"WITH c AS (SELECT s_suppkey AS cell_id, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier) SELECT cell_id, 'holed' AS region FROM c WHERE x >= 0 AND x < 4 AND y >= 0 AND y < 4 AND NOT (x >= 1 AND x < 3 AND y >= 1 AND y < 3) UNION ALL SELECT cell_id, 'beside' FROM c WHERE x >= 4 AND x < 8 AND y >= 0 AND y < 4 UNION ALL SELECT cell_id, 'bent' FROM c WHERE (x >= 0 AND x < 8 AND y >= 4 AND y < 6) OR (x >= 0 AND x < 2 AND y >= 6 AND y < 9)")
def cell_bridge(spark, sf):
    """Cells in polygons: with a hole, beside another, and bent."""
    shapes = [(n, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for n, rings in _RINGS]
    shapes = spark.createDataFrame(shapes, "region string, rings array<array<struct<x:double,y:double>>>")
    cells = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.floor(F.col("s_suppkey") / 10).cast("double").alias("y"))
    return regions.bridge(cells, shapes, 3.0)


@query("region_catalogue", "SELECT DISTINCT lower(trim(n_name)) AS region FROM nation")
def region_catalogue(spark, sf):
    return regions.catalogue(tables.table(spark, sf, "nation").withColumnRenamed("n_name", "region"))


@query("map_scales", f"WITH {_GRIDS}, {_PAIRS}, m AS (SELECT a - b AS value FROM pairs) SELECT round(-greatest(abs(min(value)), abs(max(value))), 6) AS vmin, round(greatest(abs(min(value)), abs(max(value))), 6) AS vmax FROM m")
def map_scales(spark, sf):
    """The symmetric scale of a map of differences."""
    return grid.colour_scale(sensors.bias_grid(*_grids(spark, sf)), diverging=True).select(F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query("cell_edges", f"WITH {SENSOR}, c AS (SELECT x, lead(x) OVER (ORDER BY x) - x AS up, x - lag(x) OVER (ORDER BY x) AS down FROM (SELECT DISTINCT x FROM sensor)) SELECT x AS centre, x - coalesce(down, up) / 2 AS low, x + coalesce(up, down) / 2 AS high FROM c")
def cell_edges(spark, sf):
    return sensors.cell_edges(tables.sensor(spark, sf))


@query("map_compare", f"WITH {_GRIDS}, d AS (SELECT a.value AS a, b.value AS b, a.value - b.value AS d FROM g_am a JOIN g_pm b USING (x, y) WHERE a.value IS NOT NULL AND b.value IS NOT NULL) SELECT count(*) AS n, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS max_abs, round(corr(a, b), 4) AS r FROM d")
def map_compare(spark, sf):
    return sensors.map_compare(*_grids(spark, sf)).select("n", "bias", "rmse", "max_abs", "r")


@query("observations_by_year", f"WITH {OBS} SELECT CAST(year(obs_date) AS INTEGER) AS year, count(*) AS n, round(sum(value), 4) AS total FROM obs WHERE year(obs_date) BETWEEN 1996 AND 1998 GROUP BY 1")
def observations_by_year(spark, sf):
    """Written by year and read back: the years asked for alone."""
    where = f"{tables.scratch(spark)}/observations-{uuid.uuid4().hex}"
    files.write_observations(tables.observations(spark, sf), where)
    return files.read_years(spark, where, 1996, 1998).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# -- documents: sources, figures and tables

_ASSETS = """a AS (SELECT 'Vol_' || (p_partkey % 7) || '-notes.pdf' AS source, CASE WHEN p_size % 3 = 0 THEN 'figure' ELSE 'table' END AS type, p_size AS page,
    CAST(p_partkey % 40 + 1 AS INTEGER) AS idx, p_type AS caption, p_name AS page_text FROM part)"""


def _assets(spark, sf) -> DataFrame:
    part = tables.table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "figure").otherwise("table")
    source = F.concat(F.lit("Vol_"), (F.col("p_partkey") % 7).cast("string"), F.lit("-notes.pdf"))
    return part.select(source.alias("source"), kind.alias("type"), F.col("p_size").alias("page"), (F.col("p_partkey") % 40 + 1).cast("int").alias("idx"), F.col("p_type").alias("caption"), F.col("p_name").alias("page_text"))


@query("asset_counts", f"WITH {_ASSETS} SELECT source, count(*) FILTER (type = 'figure') AS figures, count(*) FILTER (type = 'table') AS tables FROM a GROUP BY source")
def asset_counts(spark, sf):
    found = _assets(spark, sf)
    return assets.counts(found, found)


@query("asset_collisions", f"WITH {_ASSETS} SELECT type, idx, count(DISTINCT source) AS sources FROM a GROUP BY ALL HAVING count(DISTINCT source) > 1")
def asset_collisions(spark, sf):
    return assets.collisions(_assets(spark, sf))


@query("asset_caps", f"WITH {_ASSETS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY page, idx) AS k FROM a) SELECT source, type, count(*) AS n, max(page) AS last_page FROM r WHERE k <= CASE type WHEN 'table' THEN 30 ELSE 20 END GROUP BY ALL")
def asset_caps(spark, sf):
    return assets.capped(_assets(spark, sf)).groupBy("source", "type").agg(F.count("*").alias("n"), F.max("page").alias("last_page"))


@query("asset_uncapped", f"WITH {_ASSETS} SELECT source, type, count(*) AS n, max(page) AS last_page FROM a GROUP BY ALL")
def asset_uncapped(spark, sf):
    return assets.capped(_assets(spark, sf), None, None).groupBy("source", "type").agg(F.count("*").alias("n"), F.max("page").alias("last_page"))


@query("asset_records", f"WITH {_ASSETS} SELECT type, page, idx, count(*) AS n FROM a WHERE source = 'Vol_3-notes.pdf' AND type = 'table' GROUP BY ALL")
def asset_records(spark, sf):
    both = assets.registry(_assets(spark, sf).where("type = 'figure'").drop("page_text"), _assets(spark, sf).where("type = 'table'"))
    return assets.records(both, "Vol_3-notes.pdf", "table").groupBy("type", "page", "idx").agg(F.count("*").alias("n"))


@query("asset_by_page", f"WITH {_ASSETS} SELECT source, type, count(*) AS n FROM a WHERE page = 12 GROUP BY ALL")
def asset_by_page(spark, sf):
    return assets.by_number(_assets(spark, sf), "page", 12).groupBy("source", "type").agg(F.count("*").alias("n"))


@query("asset_by_number", f"WITH {_ASSETS} SELECT type, idx, min(source) AS source FROM a WHERE type = 'table' AND idx = 9 GROUP BY ALL")
def asset_by_number(spark, sf):
    return assets.by_number(_assets(spark, sf), "table", 9).select("type", "idx", "source")


@query("asset_new", f"WITH {_ASSETS} SELECT source, count(*) AS n FROM a WHERE source NOT IN ('Vol_1-notes.pdf', 'Vol_2-notes.pdf') GROUP BY source")
def asset_new(spark, sf):
    known = spark.createDataFrame([("Vol_1-notes.pdf",), ("Vol_2-notes.pdf",), ("Vol_2-notes.pdf",)], "source string")
    return assets.new_only(_assets(spark, sf), known).groupBy("source").agg(F.count("*").alias("n"))


@query("asset_of_document", f"WITH {_ASSETS} SELECT type, count(*) AS n FROM a WHERE lower(source) LIKE '%vol_5%' GROUP BY type")
def asset_of_document(spark, sf):
    mine = assets.of_document(_assets(spark, sf), "show figures of the FIFTH volume", {"fifth": "Vol_5", "first": "Vol_1"})
    return mine.groupBy("type").agg(F.count("*").alias("n"))


_ASKED_FOR = "explain the STANDARD part"


_WORDS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in assets.STOP_WORDS) + "]"
_SCORED = f"""q AS (SELECT list_distinct(list_filter({_WORDS.format(c=f"'{_ASKED_FOR}'")}, lambda w: NOT list_contains({_STOP}, w))) AS w),
    s AS (SELECT source, page, idx, 3 * len(list_intersect(w, {_WORDS.format(c="caption || ' ' || source")})) + len(list_intersect(w, {_WORDS.format(c='page_text')})) AS score FROM a, q)"""


@query("asset_relevance", f"WITH {_ASSETS}, {_SCORED} SELECT score, count(*) AS n FROM s WHERE score > 0 GROUP BY score")
def asset_relevance(spark, sf):
    """How many assets share how many words with a question."""
    return assets.relevant(_assets(spark, sf), _ASKED_FOR, 1_000_000).groupBy(F.col("score").cast("long").alias("score")).agg(F.count("*").alias("n"))


@query("asset_relevance_other", f"WITH {_ASSETS} SELECT type, page, idx, count(*) AS n FROM a WHERE page = 7 GROUP BY ALL")
def asset_relevance_other(spark, sf):
    """A page by its short name; a figure that is named but not found gives nothing beside it."""
    found = assets.relevant(_assets(spark, sf), "what is on p. 7", 1_000_000)
    none = assets.relevant(_assets(spark, sf), "describe the figure about brass", 1_000_000)
    return found.unionByName(none.withColumn("score", F.lit(1))).groupBy("type", "page", "idx").agg(F.count("*").alias("n"))


@query("asset_relevance_numbered", f"WITH {_ASSETS} SELECT source, page, idx, count(*) AS n FROM a WHERE type = 'figure' AND idx = 7 GROUP BY ALL")
def asset_relevance_numbered(spark, sf):
    return assets.relevant(_assets(spark, sf), "what does figure 7 show", 1_000_000).groupBy("source", "page", "idx").agg(F.count("*").alias("n"))


@query("asset_lines", f"WITH {_ASSETS} SELECT upper(left(type, 1)) || substr(type, 2) || ' ' || idx || ' | p.' || page || ' | ' || source || ': ' || caption || chr(10) || 'a | b' || chr(10) || 'c | d' AS line, count(*) AS n FROM a WHERE page < 4 GROUP BY ALL")
def asset_lines(spark, sf):
    found = _assets(spark, sf).where("page < 4").withColumn("text", F.lit("a | b\nc | d\ne | f"))
    return assets.listed(found, 2).groupBy("line").agg(F.count("*").alias("n"))


_IMAGES = "'fig_' || p_size || '-' || replace(p_brand, '#', '') || '.png'"


@query(
    "image_ranking",
    f"""WITH i AS (SELECT DISTINCT {_IMAGES} AS name FROM part), s AS (SELECT name, CASE WHEN regexp_matches(lower(name), '(img|image|fig|table|p\\d+_(img|table))_?0*12\\b') THEN 10 ELSE 0 END
    + 5 + 2 * (contains(lower(name), 'show')::INT + contains(lower(name), 'figure')::INT + contains(lower(name), 'from')::INT + contains(lower(name), 'brand')::INT) AS score FROM i)
    SELECT name, score FROM s ORDER BY score DESC, name LIMIT 10""",
)
def image_ranking(spark, sf):
    part = tables.table(spark, sf, "part")
    names = part.select(F.concat(F.lit("fig_"), F.col("p_size").cast("string"), F.lit("-"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".png")).alias("name")).distinct()
    return assets.ranked_images(names, "show figure 12 from the brand", 10).withColumn("score", F.col("score").cast("long"))


_NAV = "list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda c: trim(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')))"


@query("html_tables", f"SELECT page_id, CAST(1 AS INTEGER) AS idx, md5(array_to_string({_NAV}, chr(10))) AS digest, len({_NAV}) AS n_rows FROM pages WHERE len({_NAV}) >= 2")
def html_tables(spark, sf):
    """Tables of pages: those whose list of links is laid out as one. A table of one row isn't taken."""
    pages = tables.table(spark, sf, "pages")
    html = F.regexp_replace(F.regexp_replace("html", "<(/?)ul>", "<$1table>"), "<li>(.*?)</li>", "<tr><td>$1</td></tr>")
    found = assets.html_tables(pages.select("page_id", html.alias("html")))
    return found.select("page_id", "idx", F.md5("text").alias("digest"), F.size("text_rows").cast("long").alias("n_rows"))


_FILES = "f AS (SELECT s_suppkey AS id, 'My_Report-' || s_name || '  v2.PDF' AS name, '/data/' || s_suppkey || '/x_' || s_nationkey || '.docx' AS path FROM supplier)"


@query("source_names", f"WITH {_FILES}, k AS (SELECT id, path, lower(trim(regexp_replace(regexp_replace(name, '\\.(pdf|PDF)$', ''), '[_\\-\\s]+', ' ', 'g'))) AS key FROM f) SELECT id, key, array_to_string(list_transform(string_split(key, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title, string_split(path, '/')[-1] AS base, 'file://' || path AS uri, to_base64(encode(key)) AS encoded FROM k")
def source_names(spark, sf):
    """Names of files as keys, titles, base names, links and base64."""
    s = tables.table(spark, sf, "supplier")
    name = F.concat(F.lit("My_Report-"), F.col("s_name"), F.lit("  v2.PDF"))
    path = F.concat(F.lit("/data/"), F.col("s_suppkey").cast("string"), F.lit("/x_"), F.col("s_nationkey").cast("string"), F.lit(".docx"))
    return s.select(F.col("s_suppkey").alias("id"), T.source_key(name).alias("key"), T.source_title(name).alias("title"), T.base_name(path).alias("base"), T.file_uri(path).alias("uri"), T.encoded(F.encode(T.source_key(name), "UTF-8")).alias("encoded"))


@query("loaded_sources", f"WITH {CHUNKS}, {_ASSETS} SELECT source, upper(left(source, 1)) || substr(source, 2) AS title, count(*) AS chunks, CAST(0 AS BIGINT) AS figures, CAST(0 AS BIGINT) AS tables, CASE source WHEN 'src3' THEN '/a/src3' ELSE '' END AS path FROM kept GROUP BY source")
def loaded_sources(spark, sf):
    """Every loaded document with its chunks, assets and path."""
    paths = spark.createDataFrame([("src3", "/b/src3"), ("src3", "/a/src3"), ("other", "/c")], "source string, path string")
    return literature.with_paths(literature.sources(index_of(spark, sf).chunks(), _assets(spark, sf)), paths)


@query("chunks_with_tables", f"WITH {CHUNKS}, {_ASSETS}, t AS (SELECT source, count(*) AS n FROM a WHERE type = 'table' GROUP BY source), c AS (SELECT source, count(*) AS n FROM kept GROUP BY source) SELECT source, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM c) GROUP BY source")
def chunks_with_tables(spark, sf):
    """Text chunks and a chunk for each table."""
    made = _assets(spark, sf).withColumn("text", F.col("page_text"))
    return retrieval.with_tables(index_of(spark, sf).chunks(), made).groupBy("source").agg(F.count("*").alias("n"))


# -- answers

_BOX = "repeat('-', 60)"


#: The figures of each region's trend with its p, as one more table.
_FITS = _P_VALUE[: _P_VALUE.index("SELECT region, n, round(")].rstrip() + ", p AS (" + _P_VALUE[_P_VALUE.index("SELECT region, n, round(") :] + "), w AS (SELECT trends.*, p_value FROM trends JOIN p USING (region))"


@query(
    "trend_answers",
    f"""{_FITS} SELECT region, {_BOX} || chr(10) || 'TREND' || chr(10) || {_BOX} || chr(10) || 'Region: ' || region || chr(10) || 'Period: 1995-01-01 to 2001-12-31' || chr(10)
    || 'Direction: ' || CASE WHEN slope > 0 THEN 'INCREASING (Wetter)' ELSE 'DECREASING (Drier)' END || chr(10) || printf('Slope: %+.8f m³/m³/day', slope) || chr(10) || printf('Total change: %+.6f', slope * 2557) || chr(10)
    || printf('R2: %.4f, p: %.4f - ', r2, p_value) || CASE WHEN p_value < 0.05 THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END || chr(10) || 'Days: ' || n || chr(10) || {_BOX} AS answer FROM w""",
)
def trend_answers(spark, sf):
    """Each region's answer."""
    got = trend.with_p_value(trend.labelled(_trends(spark, sf), "1995-01-01", "2001-12-31"))
    return got.select("region", answers.trend_answer(F.col("region"), "1995-01-01", "2001-12-31").alias("answer"))


@query("comparison_answer", f"WITH {OBS}, {_PERIODS}, {_PHITS}, got AS (SELECT period_idx, max(value) AS value FROM hits GROUP BY period_idx), e AS (SELECT period_idx, CAST(period_start AS VARCHAR) AS label, value, value IS NOT NULL AND row_number() OVER (ORDER BY value DESC NULLS LAST, period_idx) = 1 AS winner FROM periods LEFT JOIN got USING (period_idx)) SELECT string_agg(label || ': ' || CASE WHEN value IS NULL THEN 'no data' ELSE printf('%.6f', value) || ' m³/m³' END || CASE WHEN winner THEN ' HIGHEST PEAK' ELSE '' END, chr(10) ORDER BY period_idx) || chr(10) || max(CASE WHEN winner THEN label || ' has the WETTEST PEAK (max: ' || printf('%.6f', value) || ' m³/m³)' END) AS answer FROM e")
def comparison_answer(spark, sf):
    obs = regional(spark, sf, REGION, *compare.hull(SPANS))
    return answers.comparison_answer(compare.compare_periods(obs, compare.periods(spark, SPANS), "max"), "max", F.col("period_start").cast("string"))


@query("value_answer", f"WITH {OBS}, {SLICE}, s AS (SELECT min(value) AS value, count(value) AS n FROM slice) SELECT {_BOX} || chr(10) || 'MINIMUM' || chr(10) || {_BOX} || chr(10) || '{REGION}' || chr(10) || 'min: ' || printf('%.6f', value) || ' m³/m³' || chr(10) || 'values: ' || n || chr(10) || {_BOX} AS answer FROM s")
def value_answer(spark, sf):
    one = regional(spark, sf).agg(F.min("value").alias("value"), F.count("value").alias("n"))
    return one.select(answers.value_answer("MINIMUM", "min", F.lit(REGION), F.col("value"), F.col("n")).alias("answer"))


_OFF = "CASE CAST(x AS INTEGER) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.00005 WHEN 2 THEN 1.0 END"


@query("eval_maps", f"WITH {_GRIDS}, p AS (SELECT CAST(x AS INTEGER) % 4 AS op, x, value AS a, value + {_OFF} AS b FROM g_am), d AS (SELECT op, x, a - b AS d, a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT op, x, count(*) AS n, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS max_abs FROM d GROUP BY ALL), v AS (SELECT c.op, c.x, CASE WHEN n IS NULL THEN 'SKIP' WHEN n < 3 THEN 'FAIL' WHEN abs(bias) < 1e-5 AND rmse < 1e-5 AND mae < 1e-5 THEN 'PASS' WHEN max_abs < 1e-4 THEN 'WARN' ELSE 'FAIL' END AS result FROM (SELECT DISTINCT op, x FROM p) c LEFT JOIN m USING (op, x)) SELECT CAST(op AS INTEGER) AS op, count(*) AS cases, count(*) FILTER (result = 'PASS') AS pass, count(*) FILTER (result = 'WARN') AS warn, count(*) FILTER (result = 'FAIL') AS fail, count(*) FILTER (result = 'SKIP') AS skip FROM v GROUP BY ROLLUP (op)")
def eval_maps(spark, sf):
    """Columns of a map held against copies: equal, a little off, far off, and without data."""
    op = (F.col("x").cast("int") % 4).alias("op")
    off = F.when(op == 0, 0.0).when(op == 1, 0.00005).when(op == 2, 1.0)
    p = _grids(spark, sf)[0].select(op, "x", F.col("value").alias("a"), (F.col("value") + off).alias("b"))
    m = p.select("op", "x").distinct().join(sensors.agreement(p, "op", "x"), ["op", "x"], "left")
    return evaluation.roll_up(evaluation.verdict(m)).select("op", "cases", "pass", "warn", "fail", "skip")


# -- questions of a table

_TEMPLATES = [
    # text, operation, regions, spans, problem; in SQL, of a customer's region, second region, year, month and days
    ("'Mean soil moisture in ' || r || ' in ' || mname || ' ' || y", "mean", "r", "y || '-' || mm || '-01..' || strftime(last_day(make_date(y, m, 1)), '%Y-%m-%d')", None),
    ("'highest moisture of ' || upper(r) || ' in ' || y || '?'", "maximum", "r", "y || '-01-01..' || y || '-12-31'", None),
    ("'trend of soil moisture in ' || r || ' during monsoon ' || y", "slope", "r", "y || '-06-01..' || y || '-09-30'", None),
    ("'compare ' || r || ' and ' || r2 || ' in ' || y", "comparison", "r || ',' || r2", "y || '-01-01..' || y || '-12-31'", None),
    ("'mean moisture in ' || left(long, 3) || substr(long, 5) || ' in ' || y", "mean", "long", "y || '-01-01..' || y || '-12-31'", None),
    ("'minimum in \"' || r || '\" from ' || strftime(d1, '%Y-%m-%d') || ' to ' || strftime(d2, '%Y-%m-%d')", "minimum", "r", "strftime(d1, '%Y-%m-%d') || '..' || strftime(d2, '%Y-%m-%d')", None),
    ("'UP mean for Q2 ' || y", "mean", "'uttar pradesh'", "y || '-04-01..' || y || '-06-30'", None),
    ("'mean moisture of ' || r", "mean", "r", "''", "which dates?"),
]
_LONG = [r for r in V.REGIONS if " " not in r and len(r) >= 9]


def _one_of(names: list[str], number: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({number} % {len(names)} AS INTEGER) + 1)"


def _by_template(column: int) -> str:
    quoted = lambda t: t[column] if column in (0, 2, 3) else "NULL" if t[column] is None else f"'{t[column]}'"
    return f"CASE id % {len(_TEMPLATES)} " + " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(_TEMPLATES)) + " END"


_PEOPLE = f"""p AS (SELECT c_custkey AS id, {_one_of(V.REGIONS, 'c_custkey // 8')} AS r, {_one_of(V.REGIONS, '(c_custkey // 8 + 1 + c_nationkey)')} AS r2, {_one_of(_LONG, 'c_custkey // 8')} AS long,
    CAST(2003 + c_custkey % 20 AS INTEGER) AS y, CAST(c_custkey % 12 + 1 AS INTEGER) AS m, lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS mm, {_one_of(V.MONTHS, 'c_custkey')} AS mname,
    make_date(CAST(2003 + c_custkey % 20 AS INTEGER), 1, 1) + CAST(c_custkey % 300 AS INTEGER) AS d1, make_date(CAST(2003 + c_custkey % 20 AS INTEGER), 1, 1) + CAST(c_custkey % 300 + c_nationkey AS INTEGER) AS d2 FROM customer)"""


def _pick(names: list[str], number) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int") + 1)


def _questions(spark, sf) -> DataFrame:
    """(id, text, region): a question for each customer, in eight forms, some misspelt."""
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k, group = F.col("c_custkey"), F.floor(F.col("c_custkey") / 8)
    year = (2003 + k % 20).cast("string")
    r, r2, long = _pick(V.REGIONS, group), _pick(V.REGIONS, group + 1 + F.col("c_nationkey")), _pick(_LONG, group)
    first = F.make_date((2003 + k % 20).cast("int"), F.lit(1), F.lit(1))
    d1, d2 = F.date_add(first, (k % 300).cast("int")), F.date_add(first, (k % 300 + F.col("c_nationkey")).cast("int"))
    texts = [
        F.concat(F.lit("Mean soil moisture in "), r, F.lit(" in "), _pick(V.MONTHS, k), F.lit(" "), year),
        F.concat(F.lit("highest moisture of "), F.upper(r), F.lit(" in "), year, F.lit("?")),
        F.concat(F.lit("trend of soil moisture in "), r, F.lit(" during monsoon "), year),
        F.concat(F.lit("compare "), r, F.lit(" and "), r2, F.lit(" in "), year),
        F.concat(F.lit("mean moisture in "), F.left(long, F.lit(3)), F.substr(long, F.lit(5)), F.lit(" in "), year),
        F.concat(F.lit('minimum in "'), r, F.lit('" from '), d1.cast("string"), F.lit(" to "), d2.cast("string")),
        F.concat(F.lit("UP mean for Q2 "), year),
        F.concat(F.lit("mean moisture of "), r),
    ]
    return c.select(k.alias("id"), F.element_at(F.array(*texts), (k % len(texts)).cast("int") + 1).alias("text"), r.alias("region"))


@query("question_plans", f"WITH {_PEOPLE} SELECT id, {_by_template(1)} AS operation, {_by_template(2)} AS regions, {_by_template(3)} AS spans, {_by_template(4)} AS problem FROM p WHERE NOT (id % 8 = 3 AND r = r2)")
def question_plans(spark, sf):
    """What each customer's question asks for."""
    asked = _questions(spark, sf)
    same = (F.col("id") % 8 == 3) & (F.size(F.split("regions", ",")) < 2)  # compared with itself
    return batch.plans(asked).select("id", "operation", "regions", "spans", "problem").where(~same)


@query(
    "question_routes",
    f"""WITH {_PEOPLE}, q AS (SELECT id, {_by_template(0)} AS t FROM p), s AS (SELECT id, CASE id % 16 WHEN 7 THEN 'tell me a joke no. ' || id WHEN 15 THEN t || ' by SMAP' ELSE t END AS t FROM q)
    SELECT id, CASE WHEN id % 16 = 15 THEN 'both' WHEN id % 8 IN (0, 2, 3, 5) THEN 'dataset' END AS route, id % 16 = 7 AS off_topic, id % 16 = 15 AS sensor, md5(t) AS digest FROM s""",
)
def question_routes(spark, sf):
    """Which part of the engine each customer's question is for, and the question itself.

    Words settle it where a region, a year and a word of the data are there as they are spelt. Some are off topic, some for
    the second sensor.
    """
    asked, n = _questions(spark, sf), F.col("id") % 16
    said = F.when(n == 7, F.concat(F.lit("tell me a joke no. "), F.col("id").cast("string"))).when(n == 15, F.concat("text", F.lit(" by SMAP"))).otherwise(F.col("text"))
    return batch.routes(asked.withColumn("text", said)).select("id", "route", "off_topic", "sensor", F.md5("text").alias("digest"))


_NAMES = f"""p AS (SELECT c_custkey AS id, {_one_of(_LONG, 'c_custkey')} AS long FROM customer)"""


@query("region_names", f"WITH {_NAMES} SELECT id, CASE WHEN id % 5 = 4 THEN NULL ELSE long END AS region FROM p")
def region_names(spark, sf):
    """Names of regions with a letter lost, two changed places, one doubled; and names of none."""
    k = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = _pick(_LONG, F.col("id"))
    part = lambda a, size: F.substr(n, F.lit(a), F.lit(size))
    said = [n, F.concat(part(1, 4), F.substr(n, F.lit(6))), F.concat(part(1, 3), part(5, 1), part(4, 1), F.substr(n, F.lit(6))), F.concat(part(1, 5), part(5, 1), F.substr(n, F.lit(6))), F.concat(F.lit("zz"), F.reverse(part(1, 2)), F.lit("qq"))]
    names = k.select("id", F.element_at(F.array(*said), (F.col("id") % 5).cast("int") + 1).alias("name"))
    return batch.resolved(names, V.REGIONS).select("id", "region")


_PREFIXES = ["list all loaded files", "how many tables are there", "number of charts", "show me table 3 on page 4", "open figure 12 of [Source: a.pdf] and [b.docx], [a.pdf]", "Fig. 7 in C:/x/first.PDF and notes/second.txt", "what does tab. 5 say", "on page 77", "describe the tables", "which histogram matters", "how does the moisture look", ""]
_CONV = f"q AS (SELECT conv_id, turn, list_extract([{', '.join(repr(x) for x in _PREFIXES)}], CAST((conv_id + turn) % {len(_PREFIXES)} AS INTEGER) + 1) || ' ' || coalesce(text, '') AS t FROM conversations)"
_ASKS = lambda patterns: "(" + " OR ".join("regexp_matches(lower(t), '" + p.replace("'", "''") + "')" for p in patterns) + ")"
_KIND = [("list", literature.LIST), ("table_count", literature.TABLE_COUNT), ("figure_count", literature.FIGURE_COUNT), ("asset", literature.SPECIFIC), ("table", (*literature.TABLE, *literature.TABLE_DATA)), ("figure", (r"(?:^|\W)(?:" + "|".join(re.escape(w) for w in literature.VISUAL_WORDS) + ")", *literature.VISUAL))]
_NUMBERS = [("table", r"\b(?:table|tab\.?)\s*(\d+)"), ("figure", r"\b(?:figure|fig\.?|image)\s*(\d+)"), ("page", r"\bpage\s*(\d+)")]


@query(
    "question_words",
    f"WITH {_CONV} SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_ASKS(p)} THEN '{k}'" for k, p in _KIND) + " ELSE 'text' END AS kind, "
    + "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{k}'" for k, p in _NUMBERS) + " END AS type, "
    + "CAST(CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN regexp_extract(lower(t), '{p}', 1)" for _, p in _NUMBERS) + " END AS INTEGER) AS number, "
    + r"array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\[(?:Source:\s*)?([^\]]+?)\]', 1))), '|') AS cited, "
    + r"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)([\w\-./\\]+\.(?:pdf|docx|txt|md))', 1), lambda p: regexp_extract(p, '[^/\\]*$')))), '|') AS files FROM q",
)
def question_words(spark, sf):
    """Turns of conversations, each with a question before it: its kind, the asset it names, its citations and files."""
    c = tables.table(spark, sf, "conversations")
    t = c.select("conv_id", "turn", F.concat(_pick(_PREFIXES, F.col("conv_id") + F.col("turn")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"))
    named = lambda a: F.array_join(F.array_sort(a), "|")
    q = F.col("t")
    return t.select("conv_id", "turn", literature.kind_of(q).alias("kind"), T.asset_type(q).alias("type"), T.asset_number(q).alias("number"), named(T.citations(q)).alias("cited"), named(T.named_files(q)).alias("files"))


# -- trends of several regions, agreement, uneven grids

_TREND_SPANS = SPANS[1:]
_TPERIODS = "periods AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(_TREND_SPANS)) + ") t(period_idx, period_start, period_end))"


@query(
    "engine_trends",
    f"""WITH {OBS}, {_TPERIODS}, {_TRIO}, hit AS (SELECT region, period_idx, value, obs_date FROM obs JOIN bridge USING (cell_id) JOIN periods ON obs_date BETWEEN period_start AND period_end),
    g AS (SELECT region, period_idx, obs_date, avg(value) AS value FROM hit GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (PARTITION BY region, period_idx ORDER BY obs_date) - 1 AS idx FROM g),
    t AS (SELECT region, period_idx, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(value, idx) END AS slope, CASE WHEN count(*) < 2 THEN avg(value) ELSE regr_intercept(value, idx) END AS intercept,
        CASE WHEN count(*) < 2 OR min(value) = max(value) THEN 0 ELSE regr_r2(value, idx) END AS r2 FROM d GROUP BY ALL),
    s AS (SELECT *, n - 2 AS df, CASE WHEN n > 2 AND r2 < 1 THEN sqrt(r2 * (n - 2) / (1 - r2)) END AS tt FROM t), k AS (SELECT unnest(range(0, 2001)) AS i),
    f AS (SELECT region, period_idx, sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(df + 1) / 2.0 * ln(1 + (tt * i / 2000) ** 2 / df))) * any_value(tt) / 6000 AS area FROM s, k WHERE tt IS NOT NULL GROUP BY ALL),
    p AS (SELECT s.*, CASE WHEN tt IS NOT NULL THEN 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * area WHEN n > 2 THEN 0.0 WHEN n = 2 AND r2 > 0 THEN 0.0 ELSE 1.0 END AS pv FROM s LEFT JOIN f USING (region, period_idx))
    SELECT r.region, q.period_idx, coalesce(n, 0) AS n, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(pv, 6) AS p_value, round(slope * (period_end - period_start + 1), 6) AS total_change,
        CASE WHEN slope > 0 THEN 'increasing' WHEN slope IS NOT NULL THEN 'decreasing' END AS direction, CASE WHEN n IS NULL THEN 'no data' ELSE 'ok' END AS status
    FROM regions r CROSS JOIN periods q LEFT JOIN p ON p.region = r.region AND p.period_idx = q.period_idx""",
)
def engine_trends(spark, sf):
    """Trends of three regions over three spans, with p, r2, intercept and change; one region and one span have no data."""
    known = [*THREE, "nation_1"]
    engine = Engine(spark, tables.observations(spark, sf), tables.cell_region(spark, sf), known)
    engine._span = ("1990-01-01", "2001-12-31")  # a span without data is asked for on purpose
    got = engine.execute(Plan("slope", tuple(THREE), tuple(_TREND_SPANS), output="scalar")).scalars
    six = [F.round(c, 6).alias(c) for c in ("intercept", "r2", "p_value", "total_change")]
    return got.select("region", "period_idx", "n", F.round("slope", 8).alias("slope"), *six, "direction", "status")


_UNEVEN = f"""{SENSOR}, g AS (SELECT x * (x + 3) / 4 AS x, y + CASE WHEN y % 2 = 1 THEN 0.25 ELSE 0 END AS y, avg(am) AS value FROM sensor GROUP BY ALL),
    t AS (SELECT DISTINCT x * 3 - 0.5 AS x, y + 0.375 AS y FROM sensor), xs AS (SELECT DISTINCT x FROM g), ys AS (SELECT DISTINCT y FROM g),
    b AS (SELECT t.x, t.y, (SELECT max(x) FROM xs WHERE xs.x <= t.x) AS x0, (SELECT min(x) FROM xs WHERE xs.x >= t.x) AS x1, (SELECT max(y) FROM ys WHERE ys.y <= t.y) AS y0, (SELECT min(y) FROM ys WHERE ys.y >= t.y) AS y1 FROM t)"""


def _uneven(spark, sf) -> tuple[DataFrame, DataFrame]:
    obs = tables.sensor(spark, sf)
    x, y = F.col("x") * (F.col("x") + 3) / 4, F.col("y") + F.when(F.col("y") % 2 == 1, 0.25).otherwise(0.0)
    return obs.groupBy(x.alias("x"), y.alias("y")).agg(F.avg("am").alias("value")), obs.select((F.col("x") * 3 - 0.5).alias("x"), (F.col("y") + 0.375).alias("y")).distinct()


@query(
    "regrid_linear_uneven",
    f"""WITH {_UNEVEN}, w AS (SELECT *, CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) WHEN x1 = x0 THEN 0 END AS u, CASE WHEN y1 > y0 THEN (y - y0) / (y1 - y0) WHEN y1 = y0 THEN 0 END AS v FROM b),
    c AS (SELECT x, y, x0 AS cx, y0 AS cy, (1 - u) * (1 - v) AS w FROM w UNION ALL SELECT x, y, x1, y0, u * (1 - v) FROM w UNION ALL SELECT x, y, x0, y1, (1 - u) * v FROM w UNION ALL SELECT x, y, x1, y1, u * v FROM w),
    j AS (SELECT c.x, c.y, c.w, g.value FROM c LEFT JOIN g ON g.x = c.cx AND g.y = c.cy WHERE c.w > 0 OR c.w IS NULL)
    SELECT x, y, CASE WHEN count(*) = count(value) THEN round(sum(w * value), 6) END AS value FROM j GROUP BY x, y""",
)
def regrid_linear_uneven(spark, sf):
    """Onto cells between axes with steps of any size."""
    return regrid.linear_between(*_uneven(spark, sf)).withColumn("value", F.round("value", 6))


@query("regrid_nearest_uneven", f"WITH {_UNEVEN}, n AS (SELECT x, y, CASE WHEN x - x0 < x1 - x THEN x0 WHEN x0 IS NOT NULL THEN x1 END AS cx, CASE WHEN y - y0 < y1 - y THEN y0 WHEN y0 IS NOT NULL THEN y1 END AS cy FROM b) SELECT n.x, n.y, round(value, 6) AS value FROM n LEFT JOIN g ON g.x = n.cx AND g.y = n.cy")
def regrid_nearest_uneven(spark, sf):
    return regrid.nearest_between(*_uneven(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    "sensor_significance",
    f"""WITH {_GRIDS}, {_PAIRS}, s AS (SELECT count(*) AS n, corr(a, b) AS r FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL), v AS (SELECT n, n - 2 AS df, r, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM s), k AS (SELECT unnest(range(0, 2001)) AS i),
    f AS (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(df + 1) / 2.0 * ln(1 + (t * i / 2000) ** 2 / df))) * any_value(t) / 6000 AS area FROM v, k)
    SELECT n, round(r, 4) AS r, round(1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * area, 6) AS p_value FROM v, f""",
)
def sensor_significance(spark, sf):
    return sensors.agreement(sensors.paired(*_grids(spark, sf)), with_p=True).select("n", "r", "p_value")


# -- files that are written and read back


@query("shapefile_bridge", """WITH c AS (SELECT s_suppkey AS cell_id, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey // 10 AS DOUBLE) AS y, s_nationkey FROM supplier),
    b AS (SELECT lower(trim(n_name)) AS region, min(x) - 0.5 AS x0, max(x) + 0.5 AS x1, min(y) - 0.5 AS y0, max(y) + 0.5 AS y1, floor((min(x) + max(x)) / 2) AS cx, floor((min(y) + max(y)) / 2) AS cy FROM c JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
    SELECT cell_id, region FROM c JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE NOT (x >= cx - 0.25 AND x < cx + 0.25 AND y >= cy - 0.25 AND y < cy + 0.25)""")
def shapefile_bridge(spark, sf):
    """Each nation's window with a hole, written as shapefiles and read back, and the cells in them."""
    s = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.floor(F.col("s_suppkey") / 10).cast("double").alias("y"), "s_nationkey")
    at = s.join(tables.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    box = at.groupBy("n_name").agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))])
    cx, cy = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0))])
    outer = ring(F.col("x0") - 0.5, F.col("y0") - 0.5, F.col("x1") + 0.5, F.col("y1") + 0.5)
    shapes = box.select(F.col("n_name").alias("STATE"), F.array(outer, F.reverse(ring(cx - 0.25, cy - 0.25, cx + 0.25, cy + 0.25))).alias("rings"))
    where = f"{tables.scratch(spark)}/shapes-{uuid.uuid4().hex}"
    shapefile.register(spark)
    shapes.write.format("shapefile").mode("append").save(where)
    return regions.bridge(s.select("cell_id", "x", "y"), shapefile.shapefile_regions(spark, where), 3.0)


@query("zarr_store", f"WITH {OBS} SELECT CAST(year(obs_date) AS INTEGER) AS year, count(*) AS n, round(sum(value), 4) AS total FROM obs WHERE obs_date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' GROUP BY 1")
def zarr_store(spark, sf):
    """Observations as a Zarr store of Blosc chunks, and two years of it read back."""
    where = f"{tables.scratch(spark)}/store-{uuid.uuid4().hex}.zarr"
    zarr.write(tables.observations(spark, sf), where, chunks=(180, 32, 32))
    zarr.register(spark)
    back = grid.between(spark.read.format("zarr_grid").load(where), "1996-03-01", "1998-02-28").where("value is not null")
    return back.groupBy(F.year("obs_date").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("geotiff_grid", f"WITH {OBS} SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(avg(value), 6) AS value FROM obs WHERE x BETWEEN 1 AND 8 AND y >= 2 GROUP BY ALL")
def geotiff_grid(spark, sf):
    """The map of all days' means as GeoTIFF tiles, and a box of it read back."""
    where = f"{tables.scratch(spark)}/tiles-{uuid.uuid4().hex}"
    cells = grid.cell_map(tables.observations(spark, sf), "mean")
    geotiff.write(cells.select("x", "y", "value"), where, 1.0, 16)
    geotiff.register(spark)
    box = spark.read.format("geotiff_grid").load(where).where("x between 1.0D and 8.0D and y >= 2.0D and value is not null")
    return box.select("x", "y", F.round("value", 6).alias("value"))


# -- captions by place, daily sums

_LAYOUT = """p AS (SELECT p_partkey AS k, 'doc' || (p_partkey % 7) AS source, p_size % 5 AS page, CAST((p_partkey * 37) % 3000 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 3000 + 20 + p_partkey % 40 AS DOUBLE) AS y1,
    CASE p_partkey % 6 WHEN 3 THEN ' Fig. ' || p_size || ': ' || p_name WHEN 4 THEN 'FIGURE ' || p_size || chr(10) || p_type WHEN 5 THEN 'Table ' || p_size || chr(10) || p_name WHEN 2 THEN p_name END AS text FROM part),
    f AS (SELECT * FROM p WHERE k % 6 = 0), t AS (SELECT * FROM p WHERE k % 6 = 1)"""


def _layout(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of figures, tables and text blocks."""
    k, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    texts = {3: F.concat(F.lit(" Fig. "), size, F.lit(": "), name), 4: F.concat(F.lit("FIGURE "), size, F.lit("\n"), F.col("p_type")), 5: F.concat(F.lit("Table "), size, F.lit("\n"), name), 2: name}
    text = F.coalesce(*[F.when(k % 6 == i, t) for i, t in texts.items()])
    y0 = ((k * 37) % 3000).cast("double")
    p = tables.table(spark, sf, "part").select(k.alias("box"), k.alias("block"), F.concat(F.lit("doc"), (k % 7).cast("string")).alias("source"), (F.col("p_size") % 5).alias("page"), F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(100.0).alias("x1"), (y0 + 20 + k % 40).alias("y1"), text.alias("text"))
    return p.where("box % 6 = 0"), p.where("box % 6 = 1"), p.where("text is not null")


@query(
    "figure_captions",
    f"""WITH {_LAYOUT}, c AS (SELECT * REPLACE (trim(text) AS text) FROM p WHERE regexp_matches(trim(coalesce(text, '')), '(?i)^(figure|fig\\.?)\\s*\\d+')),
    j AS (SELECT f.source, f.page, f.k AS box, c.k AS block, c.text, c.y0 - f.y1 AS down, c.y1 - f.y0 AS up FROM f JOIN c ON f.source = c.source AND f.page = c.page),
    r AS (SELECT *, least(abs(down), abs(up)) AS far, CASE WHEN down BETWEEN -10 AND 120 THEN 0 WHEN up BETWEEN -60 AND 10 THEN 1 WHEN least(abs(down), abs(up)) < 200 THEN 2 END AS rank FROM j),
    b AS (SELECT * FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY box ORDER BY rank, CASE WHEN rank = 2 THEN far ELSE 0 END, block) = 1)
    SELECT f.source, f.page, f.k AS box, replace(b.text, chr(10), ' ') AS caption, CAST(regexp_extract(b.text, '(?i)^(?:figure|fig\\.?)\\s*(\\d+)', 1) AS BIGINT) AS number FROM f LEFT JOIN b ON f.k = b.box""",
)
def figure_captions(spark, sf):
    figures, _, blocks = _layout(spark, sf)
    return captions.figure_captions(figures, blocks)


@query(
    "table_captions",
    f"""WITH {_LAYOUT}, c AS (SELECT * FROM p WHERE regexp_matches(trim(coalesce(text, '')), '(?i)^table\\s*\\d*')),
    b AS (SELECT t.k AS box, trim(c.text) AS text FROM t JOIN c ON t.source = c.source AND t.page = c.page AND c.y0 - t.y1 BETWEEN 0 AND 60 QUALIFY row_number() OVER (PARTITION BY t.k ORDER BY c.k) = 1)
    SELECT t.source, t.page, t.k AS box, coalesce(left(b.text, 200), 'Table on page ' || t.page) AS caption FROM t LEFT JOIN b ON t.k = b.box""",
)
def table_captions(spark, sf):
    _, found, blocks = _layout(spark, sf)
    return captions.table_captions(found, blocks)


def _sums(spark, sf) -> rollup.Rollup:
    made = rollup.Rollup(spark, f"{tables.scratch(spark)}/sums-{uuid.uuid4().hex}")
    made.refresh(tables.observations(spark, sf), tables.cell_region(spark, sf))
    return made


@query("rollup_regions", ORACLE_SQL["compare_regions_periods_mean"])
def rollup_regions(spark, sf):
    """Several regions over several periods, from stored daily sums."""
    days = _sums(spark, sf).days(*compare.hull(SPANS))
    return compare.regions_by_period(tables.observations(spark, sf), tables.cell_region(spark, sf), THREE, compare.periods(spark, SPANS), "mean", days).withColumn("value", F.round("value", 8))


@query("rollup_days", f"WITH {OBS}, d AS (SELECT region, obs_date, value FROM obs JOIN bridge USING (cell_id) UNION ALL SELECT 'india', obs_date, value FROM obs WHERE cell_id IN (SELECT cell_id FROM bridge)) SELECT region, CAST(year(obs_date) AS INTEGER) AS year, count(DISTINCT obs_date) AS n_days, count(value) AS n, round(sum(value), 4) AS s, min(value) AS a, max(value) AS b FROM d GROUP BY ALL")
def rollup_days(spark, sf):
    days = _sums(spark, sf).days()
    return days.groupBy("region", "year").agg(F.count("*").alias("n_days"), F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("s"), F.min("a").alias("a"), F.max("b").alias("b"))


# -- PDF files: a report of each nation, with a ruled table of its suppliers and a caption


def _reports(spark, sf) -> DataFrame:
    """(source, content): a file for each nation that has suppliers; its page is as long as its table."""
    s = tables.table(spark, sf, "supplier").join(tables.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("r"))
    n = F.size("r")
    high = 20 * n + 200
    text = lambda x, y, t: F.concat(F.lit("BT /F1 10 Tf "), x, F.lit(" "), y, F.lit(" Td ("), t, F.lit(") Tj ET\n"))
    line = lambda x0, y0, x1, y1: F.concat_ws(" ", *[c.cast("string") for c in (x0, y0)], F.lit("m"), *[c.cast("string") for c in (x1, y1)], F.lit("l S\n"))
    top = high - 100
    left, middle, right = F.lit(50), F.lit(150), F.lit(400)
    ruled = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: line(left, top - 20 * i, right, top - 20 * i)), "")
    sides = F.concat(*[line(x, top, x, top - 20 * n) for x in (left, middle, right)])
    at = lambda i: (top - 20 * i - 14).cast("string")
    cells = F.array_join(F.transform("r", lambda r, i: F.concat(text(F.lit("55"), at(i), r["s_suppkey"].cast("string")), text(F.lit("155"), at(i), r["s_name"]))), "")
    caption = text(F.lit("50"), F.lit("70"), F.concat(F.lit("Table "), F.col("n_nationkey").cast("string"), F.lit(": suppliers of "), F.col("n_name")))
    head = text(F.lit("50"), (high - 40).cast("string"), F.concat(F.lit("Report of "), F.col("n_name")))
    body = F.concat(head, ruled, sides, cells, caption)
    file = F.concat(
        F.lit("%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n"),
        F.lit("3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>> /MediaBox [0 0 600 "), high.cast("string"), F.lit("]>> endobj\n4 0 obj <</Length "),
        F.length(body).cast("string"), F.lit(">>\nstream\n"), body, F.lit("\nendstream endobj\n5 0 obj <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>> endobj\ntrailer <</Root 1 0 R>>"),
    )
    return rows.select(F.concat(F.lit("report_"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("source"), F.encode(file, "UTF-8").alias("content"))


_REPORTS = "g AS (SELECT n_nationkey AS k, n_name, count(*) AS n, string_agg(s_suppkey || ' | ' || s_name, chr(10) ORDER BY s_suppkey) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"


@query("pdf_tables", f"WITH {_REPORTS} SELECT 'report_' || k || '.pdf' AS source, CAST(1 AS INTEGER) AS page, CAST(1 AS INTEGER) AS idx, 'Table ' || k || ': suppliers of ' || n_name AS caption, md5(t) AS digest, n AS n_rows FROM g WHERE n >= 2")
def pdf_tables(spark, sf):
    """The ruled table of each report, by its rules and words, with its caption."""
    found = pages.tables(pdf.parsed(_reports(spark, sf)))
    return found.select("source", "page", "idx", "caption", F.md5("text").alias("digest"), F.size("text_rows").cast("long").alias("n_rows"))


@query("pdf_words", f"WITH w AS (SELECT n_nationkey AS k, s_name AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, CAST(s_suppkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey), {_REPORTS} SELECT 'report_' || w.k || '.pdf' AS source, t AS text, count(*) AS n FROM w GROUP BY ALL")
def pdf_words(spark, sf):
    """The words that stand within the tables' height on each report's page."""
    words = pdf.parsed(_reports(spark, sf)).where("kind = 'word' and y0 > 90")
    low = words.groupBy("source").agg(F.max("y0").alias("last"))
    return words.join(low, "source").where("y0 < last").groupBy("source", "text").agg(F.count("*").alias("n"))


# -- maps drawn


@query("map_tiles", f"WITH {OBS}, m AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, avg(value) AS value FROM obs GROUP BY x, y) SELECT CAST(floor(y / 16) AS BIGINT) AS i, CAST(floor(x / 16) AS BIGINT) AS j, 'tile_' || CAST(floor(y / 16) AS BIGINT) || '_' || CAST(floor(x / 16) AS BIGINT) || '.png' AS name, count(value) AS cells FROM m GROUP BY ALL")
def map_tiles(spark, sf):
    """The map of all days' means as PNG tiles of one scale."""
    cells = grid.cell_map(tables.observations(spark, sf), "mean").select("x", "y", "value")
    low, high = grid.colour_scale(cells).first()
    return png.write_tiles(cells, f"{tables.scratch(spark)}/map-{uuid.uuid4().hex}", low, high, "wet", 1.0, 16)


@query(
    "region_borders",
    f"WITH b AS (SELECT lower(trim(n_name)) AS region, min(s_suppkey % 10) - 0.5 AS x0, max(s_suppkey % 10) + 0.5 AS x1, min(s_suppkey // 10) - 0.5 AS y0, max(s_suppkey // 10) + 0.5 AS y1 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) SELECT region, CAST(4 AS BIGINT) AS edges, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS length FROM b",
)
def region_borders(spark, sf):
    """The edges of each nation's window, and how long they are."""
    s = tables.table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).cast("double").alias("x"), F.floor(F.col("s_suppkey") / 10).cast("double").alias("y"), "s_nationkey")
    box = s.join(tables.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("region"))
    box = box.agg((F.min("x") - 0.5).alias("x0"), (F.max("x") + 0.5).alias("x1"), (F.min("y") - 0.5).alias("y0"), (F.max("y") + 0.5).alias("y1"))
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    edges = regions.borders(box.select("region", F.array(corners).alias("rings")))
    return edges.groupBy("region").agg(F.count("*").alias("edges"), F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("length"))
