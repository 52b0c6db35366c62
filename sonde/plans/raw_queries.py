"""Queries over raw files, preparation and reports; files are written from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions import staging
from sonde.operators import alignment, cleaning, profile, windowing
from sonde.plans import preparation
from sonde.plans.queries import _LEVELS, _NUMBERS, _SQL_CODES, _SQL_HOLED, _SQL_NUMERIC, _SQL_T, _SQL_WINDOW, _holed, _sql_cramer, alert, query, r6, table
from sonde.sources import readers, writers

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _written(df: DataFrame, tag: str) -> str:
    """A folder of CSV files with df's rows in their order."""
    path = staging.new_path(df.sparkSession, tag)
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _seconds(c: str):
    return F.unix_timestamp(c).cast("long").alias("at")


# -- scans ----------------------------------------------------------------------------------


@query("SELECT floor(epoch(ts))::BIGINT AS at, event_id::BIGINT AS event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END::DOUBLE AS user_id, coalesce(event_type = 'error', false)::INT AS is_attack FROM events")
def labelled_csv_scan(spark, folder):
    raw = table(spark, folder, "events").select(
        F.concat(F.lit(" "), F.date_format("ts", readers.SWAT_FORMAT)).alias(f" {readers.SWAT_TIME}"), F.concat(F.lit(" "), F.col("event_id")).alias(" event_id "),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).otherwise("bad").alias("user_id"), F.when(F.col("event_type") == "error", " A ttack").otherwise("Normal ").alias(readers.SWAT_LABEL),
    )
    found = readers.read_labelled_csv(spark, _written(raw, "labelled"))
    return found.select(_seconds("datetime"), F.col("event_id").cast("long"), F.col("user_id").cast("double"), F.col("is_attack").cast("int"))


@query("SELECT floor(epoch(ts))::BIGINT AS at, event_id::BIGINT AS event_id, user_id::BIGINT AS user_id FROM events")
def recordings_scan(spark, folder):
    rows = table(spark, folder, "events")
    files = [_written(rows.filter(F.col("event_id") % 2 == k).select(F.date_format("ts", _STAMP).alias("timestamp "), "event_id", F.col("user_id").alias(" user_id")), "recording") for k in (0, 1)]
    return readers.read_recordings(spark, files).select(_seconds("datetime"), F.col("event_id").cast("long"), F.col("user_id").cast("long"))


@query("SELECT floor(epoch(ts))::BIGINT AS at, event_id::BIGINT AS event_id, (value > 200)::INT AS is_attack FROM events")
def side_labels_scan(spark, folder):
    rows = table(spark, folder, "events").orderBy("event_id")
    values = _written(rows.select(F.date_format("ts", _STAMP).alias("timestamp"), "event_id"), "values")
    labels = _written(rows.select(F.date_format("ts", _STAMP).alias("timestamp"), alert().cast("int").alias("label")), "labels")
    found = readers.with_side_labels(spark, values, labels)
    return found.select(_seconds("datetime"), F.col("event_id").cast("long"), F.col("is_attack").cast("int"))


def _dimensions(spark, folder) -> str:
    """A channel for each event type, with the subsystem and whether it is a target."""
    types = table(spark, folder, "events").filter("event_type IS NOT NULL").select("event_type").distinct()
    return _written(types.select(F.col("event_type").alias(" Channel"), F.substring("event_type", 1, 1).alias("Subsystem"), F.when(F.length("event_type") > 5, "YES").otherwise("NO").alias("Target"), F.lit("NO").alias("Categorical")), "channels")


@query("SELECT event_type AS channel, floor(epoch(ts))::BIGINT AS at, event_id FROM events WHERE length(event_type) > 5")
def channel_scan(spark, folder):
    path = staging.new_path(spark, "readings")
    table(spark, folder, "events").select(F.col("event_type").alias("channel"), "ts", F.col("event_id").cast("string").alias("value")).write.parquet(path)
    wanted = readers.target_channels(spark, _dimensions(spark, folder), target_only=True)
    return readers.read_channels(spark, path, wanted).select("channel", _seconds("ts"), F.col("value").cast("long").alias("event_id"))


@query("SELECT left(event_type, 1) AS subsystem, count(DISTINCT event_type) AS channels, count(DISTINCT event_type) FILTER (length(event_type) > 5) AS targets, 0::BIGINT AS categorical FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def subsystem_rollup(spark, folder):
    return profile.subsystem_rollup(readers.target_channels(spark, _dimensions(spark, folder)))


@query("SELECT event_id::VARCHAR AS id, event_type AS channel, floor(epoch(ts))::BIGINT AS first, floor(epoch(ts))::BIGINT + 60 AS last, CASE event_type WHEN 'error' THEN 'Anomaly' WHEN 'purchase' THEN 'Rare Event' END AS category FROM events")
def annotation_scan(spark, folder):
    rows = table(spark, folder, "events")
    whole = F.date_trunc("second", "ts")
    spans = _written(rows.select(F.col("event_id").alias("ID"), F.col("event_type").alias("Channel"), F.date_format(whole, "yyyy-MM-dd HH:mm:ss").alias("StartTime"), F.date_format(whole + F.expr("INTERVAL 1 MINUTE"), "yyyy-MM-dd HH:mm:ss").alias("EndTime")), "annotations")
    kinds = _written(rows.filter(F.col("event_type").isin("error", "purchase")).select(F.col("event_id").alias("ID"), F.when(F.col("event_type") == "error", "Anomaly").otherwise("Rare Event").alias("Category")), "kinds")
    found = readers.read_annotations(spark, spans, kinds)
    return found.select(F.col("ID").alias("id"), F.col("Channel").alias("channel"), F.unix_timestamp("StartTime").alias("first"), F.unix_timestamp("EndTime").alias("last"), F.col("Category").alias("category"))


@query("SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 5 <> 0 THEN user_id::VARCHAR END AS user_id FROM events")
def copy_block_scan(spark, folder):
    cells = F.concat_ws("\t", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).otherwise("\\N"))
    line = lambda k, v: F.struct(F.lit(k).cast("long").alias("k"), F.lit(v).alias("value"))
    rest = spark.range(1).select(F.explode(F.array(line(-3, "SET x;"), line(-2, "COPY public.pv (event_id, user_id) FROM stdin;"), line(1 << 60, "\\."), line((1 << 60) + 1, "COPY other (id) FROM stdin;"), line((1 << 60) + 2, "7"), line((1 << 60) + 3, "\\."))).alias("x")).select("x.*")
    lines = table(spark, folder, "events").select(F.col("event_id").cast("long").alias("k"), cells.alias("value")).unionByName(rest)
    path = staging.new_path(spark, "dump")
    lines.orderBy("k").coalesce(1).select("value").write.text(path)  # a dump is one file
    return readers.read_copy_block(spark, path, "pv")


_SQL_GREEDY = """c AS (SELECT user_id % 9 AS cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id % 9) AS k FROM events WHERE user_id IS NOT NULL GROUP BY 1),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS cluster, NULL::INTEGER AS replica, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b
  UNION ALL SELECT c.k, c.cluster, CASE WHEN g.a <= g.b THEN 0 ELSE 1 END, c.n, g.a + CASE WHEN g.a <= g.b THEN c.n ELSE 0 END, g.b + CASE WHEN g.a <= g.b THEN 0 ELSE c.n END FROM g JOIN c ON c.k = g.k + 1)"""


@query(f"WITH RECURSIVE {_SQL_GREEDY} SELECT replica, cluster, n AS n_rows FROM g WHERE k > 0")
def replica_shards(spark, folder):
    rows = table(spark, folder, "events").filter("user_id IS NOT NULL").select((F.col("user_id") % 9).cast("long").alias("_cluster"), F.col("event_id").alias("_row"))
    path = staging.new_path(spark, "shards")
    writers.write_shards(path, 2, {"queries": rows}, writers.replica_table(rows, 2))
    out = None
    for k in (0, 1):
        part = readers.read_parquet(spark, f"{path}/queries/_replica={k}").groupBy(F.lit(k).alias("replica"), F.col("_cluster").alias("cluster")).agg(F.count("*").alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_id FROM events WHERE event_type IS NOT NULL AND length(event_type) > 5
  AND ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events) AND ts + INTERVAL 90 MINUTE >= (SELECT min(ts) + INTERVAL 5 DAY FROM events)""")
def touching_spans(spark, folder):
    events = table(spark, folder, "events")
    spans = events.select("event_id", "event_type", "ts", (F.col("ts") + F.expr("INTERVAL 90 MINUTE")).alias("upto"))
    known = events.filter(F.length("event_type") > 5).select("event_type")
    from_start = lambda days: (F.min("ts") + F.expr(f"INTERVAL {days} DAY")).cast("string")
    first, last = events.agg(from_start(5), from_start(10)).first()
    kind = events.schema["ts"].dataType
    return alignment.touching(spans, known, "event_type", "ts", "upto", F.lit(first).cast(kind), F.lit(last).cast(kind)).select("event_id")


# -- choice of columns ----------------------------------------------------------------------


def _names(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(f"WITH t AS {_SQL_HOLED}, s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, avg(({c} IS NULL)::INT) AS s FROM t" for c in [*_NUMBERS, "code"]) + ") SELECT name FROM s WHERE s >= 0.2")
def sparse_columns(spark, folder):
    return _names(spark, profile.sparse_columns(_holed(spark, folder), [*_NUMBERS, "code"], 0.2))


@query(f"WITH t AS {_SQL_HOLED}, s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM t" for c in [*_NUMBERS, "steady"]) + ") SELECT name FROM s WHERE n <= 1")
def constant_columns(spark, folder):
    return _names(spark, profile.constant_columns(_holed(spark, folder), [*_NUMBERS, "steady"]))


@query("""WITH t AS (SELECT event_type, value, CASE WHEN event_type = 'error' THEN 1 ELSE user_id END AS user_id FROM events),
n AS (SELECT event_type AS part, 'value' AS name, count(DISTINCT value) AS n FROM t GROUP BY 1 UNION ALL SELECT event_type, 'user_id', count(DISTINCT user_id) FROM t GROUP BY 1) SELECT part, name FROM n WHERE n <= 1""")
def constant_in_parts(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "value", F.when(F.col("event_type") == "error", 1).otherwise(F.col("user_id")).alias("user_id"))
    return profile.constants_by(rows, ["value", "user_id"], "event_type").select(F.col("event_type").alias("part"), F.col("column").alias("name"))


_SQL_ROWS = "(SELECT event_type, value > 100 AS high, NULL::INTEGER AS nothing, CASE WHEN user_id % 4 <> 0 THEN user_id % 3 END AS third FROM events)"


@query(f"SELECT count(*) AS n_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_SQL_ROWS})))::BIGINT AS repeated_rows, 'nothing' AS constant, 'nothing,third' AS with_nulls FROM {_SQL_ROWS}")
def final_check(spark, folder):
    rows = table(spark, folder, "events").select("event_type", (F.col("value") > 100).alias("high"), F.lit(None).cast("int").alias("nothing"), F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 3).alias("third"))
    found = profile.final_check(rows, ["high", "nothing", "third"])
    return spark.createDataFrame([(found["rows"], found["repeated_rows"], ",".join(found["constant"]), ",".join(sorted(found["null_share"])))], "n_rows long, repeated_rows long, constant string, with_nulls string")


def _sql_prune(names: list[str], strength: str, ties: str) -> str:
    """The greedy choice: strength gives (c, s), ties gives (a, b) above the limit."""
    places = ", ".join(f"('{c}', {k})" for k, c in enumerate(names))
    return f"""ord AS (SELECT c, row_number() OVER (ORDER BY s DESC, place) AS k FROM ({strength}) JOIN (VALUES {places}) p(c, place) USING (c)),
tied AS (SELECT coalesce(list(a || '|' || b), []::VARCHAR[]) AS l FROM (SELECT a, b FROM ({ties}) UNION SELECT b, a FROM ({ties}))),
g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept, NULL::VARCHAR AS c, NULL::VARCHAR AS hit
  UNION ALL SELECT ord.k, CASE WHEN len(list_filter(g.kept, lambda x: list_contains(l, x || '|' || ord.c))) = 0 THEN list_append(g.kept, ord.c) ELSE g.kept END, ord.c, list_filter(g.kept, lambda x: list_contains(l, x || '|' || ord.c))[1]
  FROM g JOIN ord ON ord.k = g.k + 1 CROSS JOIN tied) SELECT c AS name, hit AS repeats FROM g WHERE k > 0"""


def _choice(spark, found: tuple[list[str], dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(c, None) for c in found[0]] + list(found[1].items()), "name string, repeats string")


_COLUMNS = [*_NUMBERS, "copy"]


@query(f"WITH RECURSIVE t AS (SELECT *, l_quantity * 2 + 1 AS copy FROM {_SQL_HOLED}), " + _sql_prune(_COLUMNS, " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS s FROM t" for c in _COLUMNS), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM t HAVING abs(corr({a}, {b})) > 0.5" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :])))
def pruned_by_pearson(spark, folder):
    return _choice(spark, profile.prune_pearson(_holed(spark, folder).withColumn("copy", F.col("l_quantity") * 2 + 1), _COLUMNS, 0.5))


_SQL_ENTROPY = " UNION ALL ".join(f"SELECT '{c}' AS c, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)), 9) AS s FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY {c})" for c in _LEVELS)
_SQL_V = " UNION ALL ".join(f"({_sql_cramer(a, b)})" for i, a in enumerate(_LEVELS) for b in _LEVELS[i + 1 :])


@query(f"WITH RECURSIVE {_SQL_T}, vs AS ({_SQL_V}), " + _sql_prune(_LEVELS, _SQL_ENTROPY, "SELECT a, b FROM vs WHERE v > 0.3"))
def pruned_by_cramer(spark, folder):
    return _choice(spark, profile.prune_cramer(table(spark, folder, "lineitem"), _LEVELS, 0.3))


@query(f"""WITH t AS {_SQL_HOLED}, p AS ({" UNION ALL ".join(f"SELECT abs(corr({a}, {b})) AS r FROM t" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :])})
SELECT count(*) AS pairs, round(avg((r > 0.8)::INT), 6) AS above_80, round(avg((r > 0.5)::INT), 6) AS above_50, round(median(r), 6) AS middle FROM p""")
def correlation_summary(spark, folder):
    found = profile.correlation_summary(profile.pearson_pairs(_holed(spark, folder), _NUMBERS))
    return found.select("pairs", *[r6(c).alias(c) for c in ("above_80", "above_50", "middle")])


# -- windows, samples and parts -------------------------------------------------------------


@query(f"""WITH {_SQL_CODES}, n AS ({_SQL_NUMERIC}), c AS (SELECT {_SQL_WINDOW} AS window_start, code, count(*)::DOUBLE AS n FROM events JOIN codes USING (event_type) GROUP BY ALL),
k AS (SELECT window_start, arg_min(code, struct_pack(less := -n, code)) AS mode, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, count(*) AS kinds, round(max(n) / sum(n), 6) AS share FROM c GROUP BY window_start)
SELECT n.window_start, round(m, 6) AS value_mean, round(s, 6) AS value_std, mode::DOUBLE AS code_mode, entropy AS code_entropy, kinds::DOUBLE AS code_nunique, share AS code_maxprop, label::INTEGER AS label FROM n JOIN k USING (window_start)""")
def window_features(spark, folder):
    coded = cleaning.factorise(table(spark, folder, "events").filter("event_type IS NOT NULL"), "event_type", ["ts", "event_id"], "code").withColumn("label", alert().cast("int"))
    rows, names = windowing.window(coded, ["value", "code"], 60, "label", ["code"], period=60, time="ts")
    return rows.select(F.unix_timestamp("ts").alias("window_start"), *[r6(n).alias(n) for n in names], F.col("label").cast("int").alias("label"))


@query("SELECT event_id, 0 AS is_anomaly FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('error', 'purchase')")
def training_rows(spark, folder):
    is_ = lambda kind: (F.col("event_type") == kind).cast("int")
    rows = table(spark, folder, "events").select("event_id", is_("error").alias("is_anomaly"), is_("purchase").alias("is_rare_event"), is_("error").alias("label_c"))
    process = preparation.EsaProcessor(spark, "", "", "events", ["x"])
    return process.prepare_train(process.prepare(rows)).select("event_id", "is_anomaly")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % 10 = 0")
def every_tenth(spark, folder):
    return cleaning.every_nth(table(spark, folder, "events").select("ts", "event_id"), ["ts", "event_id"], 10).select("event_id")


@query("""WITH f AS (SELECT event_type AS channel, min(ts) AS first FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT first, count(*) AS channels, (sum(count(*)) OVER (ORDER BY first))::BIGINT AS present FROM f GROUP BY first""")
def leading_ladder(spark, folder):
    rows = table(spark, folder, "events").filter("event_type IS NOT NULL").select("ts", F.col("event_type").alias("channel"), "event_id")
    return profile.leading_ladder(rows, "channel", "ts")


@query("""WITH e AS (SELECT event_type, (event_id % 3)::INT AS seed, value FROM events WHERE event_type IS NOT NULL), r AS (SELECT event_type, seed, avg(value) AS m FROM e GROUP BY ALL)
SELECT event_type, count(*) AS runs, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM r GROUP BY event_type""")
def repeated_runs(spark, folder):
    runs = table(spark, folder, "events").filter("event_type IS NOT NULL").groupBy("event_type", (F.col("event_id") % 3).alias("seed")).agg(F.avg("value").alias("m"))
    return profile.over_runs(runs, ["event_type"], "m").select("event_type", "runs", r6("mean").alias("mean"), r6("std").alias("std"))
