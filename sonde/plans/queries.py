"""The catalogue of queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.functions import staging
from sonde.functions.ordered import number_rows, previous, running_sum
from sonde.operators import alignment, centroids, cleaning, density, metrics, neighbours, placement, prediction, profile, runs, scaling, splitting, subgraphs, windowing
from sonde.plans import autoencoder
from sonde.streaming import windows as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


HOUR = 3600


def alert() -> Column:
    return F.col("value") > 200


# -- windows --------------------------------------------------------------------------------

_SQL_WINDOW = "(floor(epoch(ts) / 3600) * 3600)::BIGINT"
_SQL_NUMERIC = f"""SELECT {_SQL_WINDOW} AS window_start, coalesce(avg(value), 0) AS m, coalesce(stddev_pop(value), 0) AS s,
  max(CASE WHEN value > 200 THEN 1.0 ELSE 0.0 END)::DOUBLE AS label, count(*) AS n_rows FROM events GROUP BY 1"""


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = windowing.numeric_windows(table(spark, folder, "events"), ["value"], HOUR, alert(), "ts")
    return rows.withColumnRenamed("_w", "window_start").withColumnRenamed("_rows", "n_rows")


@query(f"SELECT window_start, round(m, 6) AS value_mean, round(s, 6) AS value_std, label, n_rows FROM ({_SQL_NUMERIC})")
def window_numeric(spark, folder):
    return _windows(spark, folder).select("window_start", r6("value_mean").alias("value_mean"), r6("value_std").alias("value_std"), "label", "n_rows")


@query(f"SELECT window_start, round(m, 6) AS value_mean, n_rows FROM ({_SQL_NUMERIC}) WHERE n_rows >= 7")
def window_coverage(spark, folder):
    rows = _windows(spark, folder).withColumnRenamed("n_rows", "_rows")
    return windowing.covered(rows, 14, 0.5).select("window_start", r6("value_mean").alias("value_mean"), F.col("_rows").alias("n_rows"))


_SQL_CODES = """codes AS (SELECT event_type, row_number() OVER (ORDER BY min(struct_pack(ts, event_id))) - 1 AS code FROM events WHERE event_type IS NOT NULL GROUP BY event_type)"""


@query(f"WITH {_SQL_CODES} SELECT event_id, coalesce(code, -1)::INTEGER AS code FROM events LEFT JOIN codes USING (event_type)")
def factorise(spark, folder):
    return cleaning.factorise(table(spark, folder, "events"), "event_type", ["ts", "event_id"], "code").select("event_id", "code")


@query(f"""WITH {_SQL_CODES}, c AS (SELECT {_SQL_WINDOW} AS window_start, code, count(*)::DOUBLE AS n FROM events JOIN codes USING (event_type) GROUP BY ALL),
m AS (SELECT window_start, code, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, code) AS k FROM c)
SELECT window_start, (SELECT max(code) FROM m WHERE m.window_start = c.window_start AND k = 1)::DOUBLE AS mode,
  round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, count(*)::DOUBLE AS nunique, round(max(n) / sum(n), 6) AS maxprop FROM c GROUP BY window_start""")
def window_categorical(spark, folder):
    coded = cleaning.factorise(table(spark, folder, "events"), "event_type", ["ts", "event_id"], "code")
    rows = windowing.categorical_windows(coded, ["code"], HOUR, "ts")
    return rows.select(F.col("_w").alias("window_start"), "mode", r6("entropy").alias("entropy"), "nunique", r6("maxprop").alias("maxprop"))


@query(f"""WITH w AS ({_SQL_NUMERIC}), k AS (SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS i, count(*) OVER () AS n FROM w),
s AS (SELECT avg(m) AS mm, stddev_samp(m) AS ms, avg(s) AS sm, stddev_samp(s) AS ss FROM k WHERE i < n * 7 // 10)
SELECT window_start, round((m - mm) / ms, 6) AS value_mean, round((s - sm) / ss, 6) AS value_std FROM k, s""")
def window_zscore(spark, folder):
    rows = staging.save(number_rows(_windows(spark, folder), ["window_start"], "_id"), "windows")
    train = rows.filter(F.col("_id") < rows.count() * 7 // 10)
    names = ["value_mean", "value_std"]
    scaled = scaling.apply_scaling(rows, scaling.window_statistics(train, names))
    return scaled.select("window_start", *[r6(n).alias(n) for n in names])


@query("""WITH d AS (SELECT DISTINCT l_shipdate AS t FROM lineitem), g AS (SELECT epoch(t)::BIGINT - lag(epoch(t)::BIGINT) OVER (ORDER BY t) AS gap FROM d)
SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 1""")
def sampling_period(spark, folder):
    days = table(spark, folder, "lineitem").select(F.col("l_shipdate").alias("t")).distinct()
    return windowing.gap_counts(days, "t").orderBy(F.col("n").desc(), "gap").limit(1)


@query(f"SELECT window_start, n_rows, round(m, 6) AS mean, round(s, 6) AS std, label FROM ({_SQL_NUMERIC})")
def stream_windows(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = streams.read_stream(spark, folder, schema, "events.parquet")
    return streams.drain(streams.stream_windows(stream, "value", HOUR, alert())).select("window_start", "n_rows", r6("mean").alias("mean"), r6("std").alias("std"), "label")


# -- cleaning and splits --------------------------------------------------------------------

_SQL_DUP = "(SELECT * FROM events UNION ALL SELECT * FROM events)"


@query(f"SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_SQL_DUP})) AS n_kept FROM {_SQL_DUP}")
def dedupe_rows(spark, folder):
    events = table(spark, folder, "events")
    doubled = events.unionByName(events)
    return doubled.agg(F.count("*").alias("n_rows")).join(cleaning.drop_repeated_rows(doubled).agg(F.count("*").alias("n_kept")), how="cross")


@query("SELECT event_id FROM events WHERE NOT (event_id % 5 = 0 AND event_id % 3 = 0) ")
def drop_null_rows(spark, folder):
    holed = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("b"))
    return cleaning.drop_empty_rows(holed, ["a", "b"]).select("event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Attack' ELSE 'Normal' END AS label,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice::FLOAT END AS reading FROM orders""")
def label_clean(spark, folder):
    raw = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(" A ttack ")).otherwise(F.lit(" Normal")).alias("raw"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit("  "), F.col("o_totalprice").cast("string"))).alias("reading"))
    cleaned = cleaning.only_values(raw.withColumn("label", cleaning.clean_label(F.col("raw"))), "label", ["Normal", "Attack"])
    return cleaning.to_numbers(cleaned, ["reading"]).select("o_orderkey", "label", "reading")


@query("""SELECT event_id, strftime(ts, '%d/%m/%Y %I:%M:%S %p') AS text, date_trunc('second', ts) AS parsed FROM events""")
def timestamp_parse(spark, folder):
    text = F.date_format("ts", "dd/MM/yyyy hh:mm:ss a")
    return table(spark, folder, "events").select("event_id", text.alias("text")).withColumn("parsed", F.try_to_timestamp(F.trim("text"), F.lit("d/M/yyyy h:mm:ss a")).cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def time_range(spark, folder):
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    return cleaning.between(table(spark, folder, "events"), stamp("2024-01-05 00:00:00"), stamp("2024-01-12 00:00:00"), "ts").select("event_id")


_SQL_PART = "CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'train' WHEN ts < TIMESTAMP '2024-01-24 00:00:00' THEN 'validation' ELSE 'test' END"


@query(f"""SELECT {_SQL_PART} AS part, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM events), 6) AS share, min(ts) AS first, max(ts) AS last,
  count(*) FILTER (value > 200) AS is_alert_positives, round(avg((value > 200)::INT), 6) AS is_alert_rate FROM events GROUP BY 1""")
def time_split(spark, folder):
    rows = table(spark, folder, "events").withColumn("is_alert", alert().cast("byte"))
    parts = splitting.describe_parts(splitting.with_part(rows, "2024-01-16 00:00:00", "2024-01-24 00:00:00", "ts"), "ts")
    return parts.select("part", "n_rows", r6("share").alias("share"), "first", "last", "is_alert_positives", r6("is_alert_rate").alias("is_alert_rate"))


def _sql_runs(where: str = "true") -> str:
    return f"(SELECT count(*) FROM (SELECT y, lag(y) OVER (ORDER BY ts, event_id) AS p FROM (SELECT ts, event_id, event_type = 'error' AS y, {_SQL_PART} AS part FROM events) WHERE {where}) WHERE y AND NOT coalesce(p, false))"


@query(f"""SELECT {_sql_runs()}::BIGINT AS whole, ({' + '.join(_sql_runs(f"part = '{p}'") for p in splitting.PARTS)})::BIGINT AS in_parts""")
def split_run_check(spark, folder):
    rows = splitting.with_part(table(spark, folder, "events"), "2024-01-16 00:00:00", "2024-01-24 00:00:00", "ts")
    flag = F.col("event_type") == "error"
    out = runs.count_runs(rows, ["ts", "event_id"], flag).withColumnRenamed("runs", "whole")
    pieces = None
    for p in splitting.PARTS:
        part = runs.count_runs(rows.filter(F.col("part") == p), ["ts", "event_id"], flag)
        pieces = part if pieces is None else pieces.unionByName(part)
    return out.join(pieces.agg(F.sum("runs").alias("in_parts")), how="cross")


@query("""WITH g AS (SELECT ts, lag(ts) OVER (ORDER BY ts, event_id) AS p FROM events)
SELECT p AS previous_time, ts, (floor(epoch(ts)) - floor(epoch(p)))::BIGINT AS gap FROM g WHERE p IS NOT NULL AND floor(epoch(ts)) - floor(epoch(p)) > 1200""")
def gap_report(spark, folder):
    return cleaning.gaps(table(spark, folder, "events"), -1, "ts").filter("gap > 1200")


@query("""WITH b AS (SELECT event_id, event_id % 100 AS t, user_id FROM events), s AS (SELECT *, CASE WHEN t < lag(t) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS step FROM b),
k AS (SELECT *, sum(step) OVER (ORDER BY event_id) AS block FROM s)
SELECT block::BIGINT AS block, count(*) AS n_rows, count(*) FILTER (user_id % 2 = 0) AS flagged, min(t) AS first_time, max(t) AS last_time FROM k GROUP BY block""")
def backward_blocks(spark, folder):
    rows = table(spark, folder, "events").select("event_id", (F.col("event_id") % 100).alias("t"), "user_id")
    return cleaning.block_profile(rows, "event_id", F.col("user_id") % 2 == 0, "t")


@query("""WITH n AS (SELECT l_shipdate AS t, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (n > 1) AS repeated_times, sum(n)::BIGINT AS n_rows FROM n""")
def order_check(spark, folder):
    return cleaning.order_faults(table(spark, folder, "lineitem"), "l_shipdate")


# -- joins in time --------------------------------------------------------------------------

_SQL_GRID = """bounds AS (SELECT min(ts) AS a, max(ts) AS b FROM events), grid AS (SELECT make_timestamp((s * 1000000)::BIGINT) AS t FROM bounds,
  unnest(generate_series((floor(epoch(a) / {0}) * {0})::BIGINT, floor(epoch(b))::BIGINT, {0})) AS g(s)), kinds AS (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)"""


def _grid(events: DataFrame, seconds: int) -> DataFrame:
    times = alignment.grid(events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "a", "b", seconds, "ts")
    kinds = events.select("event_type").filter("event_type IS NOT NULL").distinct()
    return times.join(F.broadcast(kinds), how="cross")  # a row for each event type


@query(f"""WITH {_SQL_GRID.format(21600)}, i AS (SELECT event_type, t FROM grid, kinds),
e AS (SELECT event_type, ts, arg_max(value, event_id) AS value FROM events GROUP BY event_type, ts)
SELECT i.event_type, i.t AS ts, e.value FROM i ASOF LEFT JOIN e ON i.event_type = e.event_type AND i.t >= e.ts""")
def asof_hold(spark, folder):
    events = table(spark, folder, "events")
    one = events.groupBy("event_type", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return alignment.hold(one, _grid(events, 21600), "event_type", "ts", "value")


@query(f"""WITH {_SQL_GRID.format(3600)}, i AS (SELECT event_type, t FROM grid, kinds),
v AS (SELECT event_type, ts AS s, ts + INTERVAL 90 MINUTE AS e, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS rank FROM events WHERE event_type IN ('error', 'purchase'))
SELECT i.event_type, i.t AS ts, coalesce(max(rank), 0)::INTEGER AS label FROM i LEFT JOIN v ON i.event_type = v.event_type AND t BETWEEN s AND e GROUP BY ALL""")
def interval_labels(spark, folder):
    events = table(spark, folder, "events")
    spans = events.filter(F.col("event_type").isin("error", "purchase")).select("event_type", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 90 MINUTE")).alias("e"))
    rank = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return alignment.interval_labels(_grid(events, 3600), spans, "event_type", "ts", "s", "e", rank, 3600)


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders), c AS (SELECT o_orderkey AS other, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders)
SELECT o_orderkey, other, (k - 1)::BIGINT AS place FROM o JOIN c USING (k)""")
def positional_zip(spark, folder):
    orders = table(spark, folder, "orders")
    left = orders.select("o_orderkey", "o_orderdate")
    right = orders.select(F.col("o_orderkey").alias("other"), "o_totalprice")
    return cleaning.positional_zip(left, right, ["o_orderdate", "o_orderkey"], ["o_totalprice", "other"]).select("o_orderkey", "other", F.col("_place").alias("place"))


@query("""WITH s AS (SELECT l_suppkey, min(l_shipdate) AS a, min(l_shipdate) + INTERVAL 40 DAY AS b FROM lineitem GROUP BY l_suppkey),
m AS (SELECT *, max(struct_pack(b, l_suppkey)) OVER (ORDER BY a, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s)
SELECT upto.l_suppkey AS earlier, l_suppkey AS later FROM m WHERE upto.b >= a""")
def overlapping_spans(spark, folder):
    spans = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("a")).withColumn("b", F.col("a") + F.expr("INTERVAL 40 DAY"))
    return cleaning.overlapping_spans(spans, "l_suppkey", "a", "b")


# -- numbering ------------------------------------------------------------------------------


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS place FROM orders")
def number_orders(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return number_rows(rows, ["o_orderdate", "o_orderkey"], "place", rows=4000).select("o_orderkey", "place")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS upto FROM orders")
def running_total(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return running_sum(rows, ["o_orderdate", "o_orderkey"], "o_totalprice", "upto", rows=4000).select("o_orderkey", F.round("upto", 2).alias("upto"))


@query("SELECT event_id, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events")
def previous_reading(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    return previous(rows, ["ts", "event_id"], {"before": "value"}, ["event_type"], rows=3000).select("event_id", "before")


# -- profiles -------------------------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _holed(spark, folder) -> DataFrame:
    holes = F.col("l_orderkey") % 5 == 0
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.when(~holes, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("l_discount"), "l_tax", F.when(~holes, F.col("l_linenumber")).alias("code"), F.lit(1).alias("steady"))


_SQL_HOLED = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_linenumber > 1 THEN l_discount END AS l_discount, l_tax, CASE WHEN l_orderkey % 5 <> 0 THEN l_linenumber END AS code, 1 AS steady FROM lineitem)"""


def _sql_each(columns: list[str], select: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c=c)} FROM t" for c in columns)


@query(f"WITH t AS {_SQL_HOLED} {_sql_each(_NUMBERS, 'round(avg(({c} IS NULL)::INT), 6) AS null_share')}")
def null_share(spark, folder):
    return profile.null_share(_holed(spark, folder), _NUMBERS).select("column", r6("null_share").alias("null_share"))


@query(f"WITH t AS {_SQL_HOLED} {_sql_each([*_NUMBERS, 'code', 'steady'], 'count(DISTINCT {c}) AS levels')}")
def levels(spark, folder):
    return profile.levels(_holed(spark, folder), [*_NUMBERS, "code", "steady"])


@query(f"WITH t AS {_SQL_HOLED} {_sql_each(_NUMBERS, 'round(median({c}), 6) AS value')}")
def medians(spark, folder):
    return profile.medians(_holed(spark, folder), _NUMBERS).select("column", r6("value").alias("value"))


@query(f"""WITH t AS (SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber FROM lineitem),
n AS (SELECT 'l_returnflag' AS c, l_returnflag AS v, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'l_linenumber', l_linenumber, count(*) FROM t GROUP BY ALL)
SELECT c AS "column", v AS value, n FROM n WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, v) = 1""")
def modes(spark, folder):
    return profile.modes(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(f"""WITH t AS {_SQL_HOLED}, q AS (SELECT median(l_quantity) AS m FROM t), d AS (SELECT median(l_discount) AS m FROM t)
SELECT round(sum(coalesce(l_quantity, q.m)), 2) AS quantity, round(sum(coalesce(l_discount, d.m)), 2) AS discount, count(*) AS n_rows FROM t, q, d""")
def impute(spark, folder):
    rows = _holed(spark, folder)
    filled = profile.imputed(rows, profile.fill_values(rows, ["l_quantity", "l_discount"], []))
    return filled.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"), F.count("*").alias("n_rows"))


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(f"WITH t AS {_SQL_HOLED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM t" for a, b in _PAIRS))
def pearson_pairs(spark, folder):
    return profile.pearson_pairs(_holed(spark, folder), _NUMBERS).select("a", "b", r6("r").alias("r"))


@query()
def prune_pearson(spark, folder):
    rows = _holed(spark, folder).withColumn("copy", F.col("l_quantity") * 2 + 1)
    kept, gone = profile.prune_pearson(rows, [*_NUMBERS, "copy"])
    return spark.createDataFrame([(c, None) for c in kept] + list(gone.items()), "column string, repeats string")


_LEVELS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _sql_cramer(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(coalesce((WITH n AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
  r AS (SELECT x, sum(n) AS rx FROM n GROUP BY x), c AS (SELECT y, sum(n) AS cy FROM n GROUP BY y), k AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc, (SELECT sum(n) FROM n) AS tot),
  o AS (SELECT abs(coalesce(n, 0) - rx * cy / tot) AS d, rx * cy / tot AS e, nr, nc FROM r CROSS JOIN c CROSS JOIN k LEFT JOIN n USING (x, y))
  SELECT CASE WHEN max(least(nr, nc)) < 2 THEN 0 ELSE sqrt(sum(CASE WHEN nr = 2 AND nc = 2 THEN (d - least(0.5, d)) * (d - least(0.5, d)) ELSE d * d END / e) / ((SELECT count(*) FROM t) * (max(least(nr, nc)) - 1))) END FROM o), 0), 6) AS v"""


_SQL_T = "t AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_returnflag = 'R' AS returned, l_linestatus = 'O' AS still_open FROM lineitem)"


@query(f"WITH {_SQL_T} " + " UNION ALL ".join(_sql_cramer(a, b) for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))))
def cramer_v(spark, folder):
    return profile.cramer_pairs(table(spark, folder, "lineitem"), _LEVELS).select("a", "b", r6("v").alias("v"))


@query(f"WITH {_SQL_T} {_sql_cramer('returned', 'still_open')}")
def cramer_yates(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("still_open"))
    return profile.cramer_pairs(rows, ["returned", "still_open"]).select("a", "b", r6("v").alias("v"))


@query("WITH t AS (SELECT * FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(CASE WHEN count(*) < 2 THEN 0 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) END, 6) AS entropy FROM (SELECT count(*)::DOUBLE AS n FROM t GROUP BY {c})" for c in _LEVELS))
def entropy_norm(spark, folder):
    return profile.entropies(table(spark, folder, "lineitem"), _LEVELS).select("column", r6("entropy").alias("entropy"))


@query("WITH t AS (SELECT * FROM lineitem) " + _sql_each(_NUMBERS, "count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, round(median({c}), 6) AS median, max({c}) AS max"))
def describe(spark, folder):
    return profile.describe(table(spark, folder, "lineitem"), _NUMBERS).select("column", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min", r6("median").alias("median"), "max")


@query("""WITH s AS (SELECT event_type, value > 100 AS v, lag(value > 100) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
SELECT event_type, count(*) AS n_rows, count(*) FILTER (p IS NOT NULL AND v <> p) AS changes, round(count(*) FILTER (p IS NOT NULL AND v <> p) / count(*), 6) AS rate FROM s GROUP BY event_type""")
def transitions(spark, folder):
    rows = table(spark, folder, "events").withColumn("state", F.col("value") > 100)
    return windowing.rate_of_change(rows, "event_type", ["ts", "event_id"], "state").select("event_type", "n_rows", "changes", r6("rate").alias("rate"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, count(*) FILTER (value > 200) AS flagged, round(avg((value > 200)::INT), 6) AS share FROM events GROUP BY 1")
def daily_density(spark, folder):
    return profile.flagged_share(table(spark, folder, "events"), alert(), F.date_format("ts", "yyyy-MM-dd"), "day").select("day", "n_rows", "flagged", r6("share").alias("share"))


@query("""WITH n AS (SELECT 'l_returnflag' AS c, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY c) AS levels, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS i FROM n)
SELECT c AS "column", levels, v AS state, n, round(n / (SELECT count(*) FROM lineitem), 6) AS share FROM k WHERE i = 1""")
def state_profile(spark, folder):
    return profile.state_profile(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"]).select("column", "levels", "state", "n", r6("share").alias("share"))


@query("""WITH e AS (SELECT ts, event_id, event_type = 'error' AS y FROM events), s AS (SELECT *, CASE WHEN y AND NOT coalesce(lag(y) OVER (ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS st FROM e),
g AS (SELECT *, sum(st) OVER (ORDER BY ts, event_id) AS run FROM s), n AS (SELECT run, count(*) AS n FROM g WHERE y GROUP BY run)
SELECT count(*) AS segments, min(n) AS least, median(n) AS middle, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share FROM n""")
def segment_summary(spark, folder):
    out = runs.segment_summary(table(spark, folder, "events"), ["ts", "event_id"], F.col("event_type") == "error")
    return out.withColumn("largest_share", r6("largest_share"))


@query("""SELECT event_type, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events) x WHERE x.event_type = e.event_type) AS users,
  count(*) FILTER (value IS NULL) AS missing FROM events e GROUP BY event_type""")
def label_counts(spark, folder):
    events = table(spark, folder, "events")
    users = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("users"))
    return events.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum(F.col("value").isNull().cast("long")).alias("missing")).join(users, "event_type").select("event_type", "n_rows", "users", "missing")


# -- the graph ------------------------------------------------------------------------------

_GRAPH = neighbours.NeighbourhoodGraph(min_similarity=0.3)  # 30 orderings, band 30
_WIDTH, _MIN_PTS = 64, 5


def _vectors(spark, folder) -> DataFrame:
    """Objects with vectors as they are kept; where rows are dealt out many times, floats take half of what doubles do."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_vec"), "label")


def _objects(spark, folder) -> DataFrame:
    return _vectors(spark, folder).withColumn("_vec", F.col("_vec").cast("array<double>"))


_SQL_SIG = "sig AS (SELECT vec_id AS id, ({}) AS s FROM embeddings)".format(" + ".join(f"CASE WHEN list_dot_product(embedding::DOUBLE[], {[float(x) for x in h]}::DOUBLE[]) >= 0 THEN {1 << k} ELSE 0 END" for k, h in enumerate(_GRAPH.planes(_WIDTH))))
_SQL_POS = "pos AS ({})".format(" UNION ALL ".join(f"SELECT {p} AS perm, id, row_number() OVER (ORDER BY " + " + ".join(f"((s >> {bit}) & 1) * {1 << (_GRAPH.bits - 1 - place)}" for place, bit in enumerate(order)) + ", id) AS pos FROM sig" for p, order in enumerate(_GRAPH.orders())))
_SQL_CAND = f"cand AS (SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM pos a JOIN pos b ON a.perm = b.perm AND b.pos > a.pos AND b.pos <= a.pos + {_GRAPH.band} AND a.id <> b.id)"
_SQL_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
_SQL_EDGES = "edges AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.x, b.x) AS sim FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.3)"
_SQL_BOTH = "both_ AS (SELECT src AS u, dst AS w FROM edges UNION ALL SELECT dst, src FROM edges)"
_SQL_CORES = f"cores AS (SELECT u AS node, count(*) AS degree FROM both_ GROUP BY u HAVING count(*) >= {_MIN_PTS})"
_SQL_CLUSTERS = f"""{_SQL_V}, {_SQL_EDGES}, {_SQL_BOTH}, {_SQL_CORES},
reach(node, label) AS (SELECT node, node + 1 FROM cores UNION SELECT b.w, r.label FROM reach r JOIN both_ b ON b.u = r.node JOIN cores c ON c.node = b.w),
top AS (SELECT node, max(label) AS label FROM reach GROUP BY node),
state AS (SELECT v.id AS node, coalesce(max(CASE WHEN t.node = v.id OR b.u IS NOT NULL THEN t.label END), 0)::BIGINT AS cluster FROM v LEFT JOIN both_ b ON b.w = v.id LEFT JOIN top t ON t.node = v.id OR t.node = b.u GROUP BY v.id)"""


@query(f"WITH {_SQL_SIG} SELECT id AS vec_id, s::BIGINT AS signature FROM sig")
def lsh_signature(spark, folder):
    return _GRAPH.signed(_objects(spark, folder), _WIDTH).select(F.col("_id").alias("vec_id"), F.col("_sig").alias("signature"))


@query(f"WITH {_SQL_SIG}, {_SQL_POS} SELECT perm, id AS vec_id, (pos - 1)::BIGINT AS place FROM pos")
def lsh_positions(spark, folder):
    placed = _GRAPH.positions(_GRAPH.signed(_objects(spark, folder), _WIDTH))
    return placed.select(F.col("_perm").alias("perm"), F.col("_id").alias("vec_id"), F.col("_pos").alias("place"))


@query(f"WITH {_SQL_SIG}, {_SQL_POS}, {_SQL_CAND} SELECT src, dst FROM cand")
def lsh_candidates(spark, folder):
    signed = staging.save(_GRAPH.signed(_objects(spark, folder).select("_id", "_vec"), _WIDTH), "signed")
    return _GRAPH.candidates(signed).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


@query(f"WITH {_SQL_SIG}, {_SQL_POS}, {_SQL_CAND}, {_SQL_V} SELECT src, dst, round(list_cosine_similarity(a.x, b.x), 6) AS similarity FROM cand JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE list_cosine_similarity(a.x, b.x) >= 0.3")
def graph_edges(spark, folder):
    edges = _GRAPH.edges(_objects(spark, folder), _WIDTH)
    return edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), r6("similarity").alias("similarity"))


def _edges(spark, folder, *of: str) -> DataFrame:
    return staging.save(neighbours.cosine_pairs(_vectors(spark, folder), 0.3).select("_src", "_dst", *of), "edges")


def _state(spark, folder, rate: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = _edges(spark, folder)
    cores = staging.save(density.core_objects(edges, _MIN_PTS), "cores")
    vertices = _objects(spark, folder).select(F.col("_id").alias("_node"))
    return density.find_clusters(vertices, edges, cores, rate), edges, cores


@query(f"WITH {_SQL_V}, {_SQL_EDGES} SELECT src, dst, round(sim, 6) AS similarity FROM edges")
def cosine_edges(spark, folder):
    return _edges(spark, folder, "similarity").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), r6("similarity").alias("similarity"))


@query(f"WITH {_SQL_V}, {_SQL_EDGES}, {_SQL_BOTH}, {_SQL_CORES} SELECT node, degree FROM cores")
def core_objects(spark, folder):
    return density.core_objects(_edges(spark, folder), _MIN_PTS).select(F.col("_node").alias("node"), "degree")


@query(f"WITH RECURSIVE {_SQL_CLUSTERS} SELECT node, cluster FROM state")
def density_clusters(spark, folder):
    return _state(spark, folder)[0].select(F.col("_node").alias("node"), F.col("_cluster").alias("cluster"))


@query(f"""WITH RECURSIVE {_SQL_CLUSTERS}, sizes AS (SELECT cluster, count(*) AS n FROM state GROUP BY cluster)
SELECT sum(n)::BIGINT AS nodes, count(*) FILTER (cluster <> 0) AS clusters, coalesce(sum(n) FILTER (cluster = 0), 0)::BIGINT AS noise, round(coalesce(sum(n) FILTER (cluster = 0), 0) / sum(n), 6) AS noise_share,
  max(n) FILTER (cluster <> 0) AS largest, median(n) FILTER (cluster <> 0) AS median_size, round(max(n) FILTER (cluster <> 0) / sum(n), 6) AS largest_share FROM sizes""")
def cluster_summary(spark, folder):
    out = density.summarise(_state(spark, folder)[0])
    return out.withColumn("noise_share", r6("noise_share")).withColumn("largest_share", r6("largest_share"))


def _sql_rounds(rate: float, rounds: int) -> str:
    parts = ["s0 AS (SELECT v.id AS node, coalesce(c.node + 1, 0) AS label FROM v LEFT JOIN cores c ON c.node = v.id)", "g0 AS (SELECT true AS go)"]
    for k in range(rounds):
        parts.append(f"h{k} AS (SELECT b.w AS node, max(a.label) AS best, count(*) AS n FROM both_ b JOIN cores c ON c.node = b.u JOIN s{k} a ON a.node = b.u JOIN s{k} z ON z.node = b.w WHERE a.label > z.label GROUP BY b.w)")
        parts.append(f"s{k + 1} AS (SELECT s.node, CASE WHEN g.go THEN greatest(s.label, coalesce(h.best, 0)) ELSE s.label END AS label FROM s{k} s CROSS JOIN g{k} g LEFT JOIN h{k} h USING (node))")
        parts.append(f"g{k + 1} AS (SELECT go AND (SELECT coalesce(sum(n), 0) FROM h{k}) >= {rate} * (SELECT count(*) FROM both_) AS go FROM g{k})")
    return ", ".join(parts)


@query(f"WITH {_SQL_V}, {_SQL_EDGES}, {_SQL_BOTH}, {_SQL_CORES}, {_sql_rounds(0.05, 10)} SELECT node, label::BIGINT AS cluster FROM s10")
def propagation_early_stop(spark, folder):
    return _state(spark, folder, 0.05)[0].select(F.col("_node").alias("node"), F.col("_cluster").alias("cluster"))


def _sql_placed(pool: str) -> str:
    return f"""SELECT q.id AS vec_id, p.id AS placed_on, list_cosine_similarity(q.x, p.x) AS sim FROM v q JOIN {pool} p ON q.id <> p.id
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY sim DESC, p.id) = 1"""


_SQL_POOL = "pool AS (SELECT v.*, s.cluster FROM v JOIN state s ON s.node = v.id WHERE s.cluster <> 0)"


def _all_queries(objects: DataFrame) -> DataFrame:
    """Every object, to be placed on another one."""
    return objects.select(F.col("_id").alias("_row"), "_vec", F.col("_id").alias("_ex"), "label")


def _placed(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    state, _, cores = _state(spark, folder)
    objects = _objects(spark, folder)
    pool, queries = placement.placement_pool(objects, state, cores), _all_queries(objects)
    return staging.save(placement.place(queries, pool), "placed"), queries, pool


def _shown(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("_row").alias("vec_id"), F.col("_core").alias("placed_on"), r6("_sim").alias("similarity"))


@query(f"WITH RECURSIVE {_SQL_CLUSTERS}, {_SQL_POOL} SELECT vec_id, placed_on, round(sim, 6) AS similarity FROM ({_sql_placed('pool')})")
def placed(spark, folder):
    return _shown(_placed(spark, folder)[0])


@query(f"WITH {_SQL_V} SELECT vec_id, placed_on, round(sim, 6) AS similarity FROM ({_sql_placed('v')})")
def placed_elsewhere(spark, folder):
    objects = _objects(spark, folder)
    return _shown(placement.place(_all_queries(objects), objects, broadcast_bytes=100_000))


@query(f"WITH RECURSIVE {_SQL_CLUSTERS}, {_SQL_POOL} SELECT count(*) AS n_rows, round(min(sim), 6) AS least, round(avg(sim), 6) AS mean FROM ({_sql_placed('pool')})")
def placement_stats(spark, folder):
    found, queries, pool = _placed(spark, folder)
    placement.audit(found, queries, pool)
    return placement.placement_stats(found).select("n_rows", r6("least").alias("least"), r6("mean").alias("mean"))


_SQL_ATTACH = f"""WITH RECURSIVE {_SQL_CLUSTERS}, core_pool AS (SELECT v.* FROM v JOIN state s ON s.node = v.id JOIN cores c ON c.node = v.id WHERE s.cluster <> 0),
pl AS (SELECT q.id AS row_, p.id AS core FROM v q JOIN core_pool p ON q.id <> p.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.x, p.x) DESC, p.id) = 1),
ties AS (SELECT pl.row_, m.node FROM pl JOIN state k ON k.node = pl.core JOIN state m ON m.cluster = k.cluster AND m.node <> pl.row_ JOIN v a ON a.id = pl.row_ JOIN v b ON b.id = m.node WHERE m.node = pl.core OR list_cosine_similarity(a.x, b.x) >= 0.3)"""


def _asked(spark, folder) -> tuple[DataFrame, DataFrame]:
    """All objects as questions to the cluster of the core that they are placed on, and the clusters' content."""
    state, edges, cores = _state(spark, folder)
    objects = _vectors(spark, folder)
    pool = placement.placement_pool(objects, state, cores, "core")
    found = placement.place(_all_queries(objects), pool)
    return subgraphs.questions(found, state, objects, leave_out=True), subgraphs.content(objects, state, edges)


@query(f"{_SQL_ATTACH} SELECT row_ AS vec_id, node FROM ties")
def subgraph_attach(spark, folder):
    return subgraphs.attached(*_asked(spark, folder), 0.3).select(F.col("_row").alias("vec_id"), F.col("_node").alias("node"))


@query(f"""{_SQL_ATTACH}, inner_ AS (SELECT u, w FROM both_ JOIN state a ON a.node = u JOIN state b ON b.node = w WHERE a.cluster = b.cluster AND a.cluster <> 0)
SELECT row_ AS vec_id, node FROM ties UNION SELECT t.row_, i.w FROM ties t JOIN inner_ i ON i.u = t.node""")
def hop_ball(spark, folder):
    return subgraphs.ball(*_asked(spark, folder), 0.3, 2).select(F.col("_row").alias("vec_id"), F.col("_node").alias("node"))


@query(f"WITH {_SQL_V}, {_SQL_EDGES}, {_SQL_BOTH} SELECT u AS node, count(*) AS neighbours, sum(w)::BIGINT AS id_sum, min(w) AS first, max(w) AS last FROM both_ GROUP BY u")
def adjacency_degree(spark, folder):
    lists = subgraphs.adjacency(_edges(spark, folder))
    return lists.select(F.col("_node").alias("node"), F.size("_nb").cast("long").alias("neighbours"), F.aggregate("_nb", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"), F.element_at("_nb", 1).alias("first"), F.element_at("_nb", -1).alias("last"))


# -- prediction and detectors ---------------------------------------------------------------

_SQL_PRED = f"""WITH RECURSIVE {_SQL_CLUSTERS}, {_SQL_POOL},
pl AS (SELECT q.id AS row_, p.cluster FROM v q JOIN pool p ON q.id <> p.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.x, p.x) DESC, p.id) = 1),
pred AS (SELECT row_, a.label, sum(list_cosine_similarity(a.x, m.x) * m.label) / sum(list_cosine_similarity(a.x, m.x)) AS guess FROM pl JOIN v a ON a.id = pl.row_ JOIN pool m ON m.cluster = pl.cluster GROUP BY row_, a.label)"""


def _predictions(spark, folder) -> DataFrame:
    state, _, cores = _state(spark, folder)
    objects = _objects(spark, folder)
    queries = _all_queries(objects)
    found = placement.place(queries, placement.placement_pool(objects, state, cores))
    return prediction.weighted_targets(found, state, queries, objects, "label").join(queries.select("_row", "label"), "_row")


@query(f"{_SQL_PRED} SELECT row_ AS vec_id, round(guess, 5) AS prediction FROM pred")
def weighted_prediction(spark, folder):
    return _predictions(spark, folder).select(F.col("_row").alias("vec_id"), F.round("prediction", 5).alias("prediction"))


@query(f"{_SQL_PRED}, g AS (SELECT label, sum((guess - label) * (guess - label)) AS sq, sum(abs(guess - label)) AS ab, count(*) AS n FROM pred GROUP BY label) SELECT round(sqrt(sum(sq) / sum(n)), 5) AS rmse_pooled, round(avg(sqrt(sq / n)), 5) AS rmse_macro, round(sum(ab) / sum(n), 5) AS mae FROM g")
def rmse_pooled_macro(spark, folder):
    return metrics.rmse(_predictions(spark, folder), "label", "prediction", ["label"]).select(*[F.round(c, 5).alias(c) for c in ("rmse_pooled", "rmse_macro", "mae")])


@query(f"""WITH {_SQL_V}, p AS (SELECT list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.id < b.id)
SELECT 0.5 AS share, round(quantile_cont(s, 0.5), 6) AS similarity FROM p UNION ALL SELECT 0.9, round(quantile_cont(s, 0.9), 6) FROM p UNION ALL SELECT 0.99, round(quantile_cont(s, 0.99), 6) FROM p""")
def similarity_quantiles(spark, folder):
    return prediction.similarity_quantiles(_objects(spark, folder), [0.5, 0.9, 0.99]).select("share", r6("similarity").alias("similarity"))


@query("""WITH d AS (SELECT ts::DATE AS d, value FROM events), b AS (SELECT min(d) AS a, max(d) AS z FROM d)
SELECT strftime(t, '%Y-%m-%d') AS test_day, count(*) AS n_rows, round(avg(value), 6) AS mean FROM d, b, unnest(generate_series(d.d + INTERVAL 1 DAY, d.d + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS g(t) WHERE t <= z AND t > a GROUP BY 1""")
def rolling_refit(spark, folder):
    rows = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "value")
    return prediction.rolling_days(rows, "day", 5).groupBy(F.date_format("test_day", "yyyy-MM-dd").alias("test_day")).agg(F.count("*").alias("n_rows"), r6(F.avg("value")).alias("mean"))


@query(f"WITH {_SQL_V} SELECT q.id AS vec_id, round(min(list_distance(q.x, c.x)), 6) AS score FROM v q, (SELECT * FROM v WHERE id < 4) c GROUP BY q.id")
def kmeans_score(spark, folder):
    objects = _objects(spark, folder)
    fixed = [list(r["_vec"]) for r in objects.filter("_id < 4").orderBy("_id").collect()]  # four rows
    return centroids.scored(objects, fixed).select(F.col("_id").alias("vec_id"), r6("score").alias("score"))


@query()
def kmeans_fit(spark, folder):
    objects = _objects(spark, folder)
    return centroids.scored(objects, centroids.fit(objects, 8)).select(F.col("_id").alias("vec_id"), "score")


_SQL_YS = "e AS (SELECT ts, event_id, (event_type = 'error')::INT AS y, value AS s FROM events)"


def _scored_events(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("ts", "event_id", (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"))


@query(f"""WITH {_SQL_YS}, c AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM e GROUP BY s), k AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM c)
SELECT max(P + N)::BIGINT AS n_rows, max(P)::BIGINT AS positives, round(max(P / (P + N)), 6) AS base_rate, round(sum(neg * (tp - pos / 2.0)) / max(P * N), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(P), 6) AS average_precision FROM k""")
def roc_ap(spark, folder):
    return metrics.ranking(_scored_events(spark, folder)).select("n_rows", "positives", *[r6(c).alias(c) for c in ("base_rate", "roc_auc", "average_precision")])


@query(f"""WITH {_SQL_YS}, c AS (SELECT count(*) FILTER (s >= 150 AND y = 1) AS tp, count(*) FILTER (s >= 150 AND y = 0) AS fp, count(*) FILTER (s < 150 AND y = 1) AS fn, count(*) FILTER (s < 150 AND y = 0) AS tn FROM e)
SELECT tp, fp, fn, tn, tp + fp AS flagged, round((tp + fp) / (tp + fp + fn + tn), 6) AS flagged_share, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def f1_at_threshold(spark, folder):
    return metrics.at_threshold(_scored_events(spark, folder), 150.0).select("tp", "fp", "fn", "tn", "flagged", *[r6(c).alias(c) for c in ("flagged_share", "precision", "recall", "f1")])


@query(f"""WITH {_SQL_YS}, q AS (SELECT quantile_cont(s, {np.linspace(*metrics.GRID).tolist()}) AS t FROM e), t AS (SELECT i - 1 AS k, t[i] AS threshold FROM q, unnest(generate_series(1, {metrics.GRID[2]})) AS g(i)),
f AS (SELECT k, threshold, 2 * count(*) FILTER (s >= threshold AND y = 1) / (2 * count(*) FILTER (s >= threshold AND y = 1) + count(*) FILTER (s >= threshold AND y = 0) + count(*) FILTER (s < threshold AND y = 1)) AS f1 FROM t, e GROUP BY ALL)
SELECT k::INTEGER AS k, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f""")
def threshold_search(spark, folder):
    return metrics.threshold_curve(_scored_events(spark, folder)).select("k", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"""WITH {_SQL_YS}, m AS (SELECT *, CASE WHEN y = 1 AND coalesce(lag(y) OVER (ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS st FROM e), g AS (SELECT *, sum(st) OVER (ORDER BY ts, event_id) AS run FROM m),
h AS (SELECT run, max((s >= 150)::INT) AS hit FROM g WHERE y = 1 GROUP BY run) SELECT count(*) AS segments, sum(hit)::BIGINT AS segments_caught, round(sum(hit) / count(*), 6) AS segment_recall FROM h""")
def segment_recall(spark, folder):
    return metrics.segment_recall(_scored_events(spark, folder), ["ts", "event_id"], 150.0).withColumn("segment_recall", r6("segment_recall"))


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 9 <> 0 THEN value END, (SELECT max(value) * 1.01 FROM events WHERE event_id % 9 <> 0)), 6) AS score FROM events")
def score_fill(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("score"))
    return metrics.fill_scores(rows).select("event_id", r6("score").alias("score"))


@query()
def gae_scores(spark, folder):
    state, _, cores = _state(spark, folder)
    objects = _vectors(spark, folder)
    queries = _all_queries(objects)
    found = placement.place(queries, placement.placement_pool(objects, state, cores))
    asked = staging.save(subgraphs.questions(found, state, objects, leave_out=True), "asked")
    settings = autoencoder.Settings(hidden=16, latent=8, batch_size=64, replicas=2)
    graphs, members = subgraphs.shared(asked, subgraphs.members(objects, state), 0.3)
    graphs, members = autoencoder.save_shared(graphs), autoencoder.hold(members)
    model, _, _ = autoencoder.fit(graphs, _WIDTH, settings, fixed_epochs=2, members=members)
    return autoencoder.scores(graphs, model, members).select(F.col("_row").alias("vec_id"), F.col("score"))


@query()
def pca_variance(spark, folder):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, folder, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    shares = PCA(k=16, inputCol="features", outputCol="p").fit(rows).explainedVariance.toArray()
    return spark.createDataFrame([(k + 1, float(s), float(t)) for k, (s, t) in enumerate(zip(shares, np.cumsum(shares), strict=True))], "component int, share double, upto double")
