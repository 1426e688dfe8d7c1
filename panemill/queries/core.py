"""Queries on ingest, relational operators, windows and panes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.tables import shared_folder
from panemill.functions.time import WindowSpec, align_start
from panemill.operators import pane_table as PT
from panemill.operators import panes as P
from panemill.operators import relational as R
from panemill.operators import windows as W
from panemill.queries.registry import ANCHOR, HOUR, OBS, PANE, PANES, REC, SPEC, WINS, obs, query, rounded, sliding, states
from panemill.sources import observations as S
from panemill.sources.logs import read_json_log

KEEP = "round({0}, 8) AS {0}"
PROPERTY, TS, VALUE = (S.PREDICATES[p] for p in ("property", "ts", "value"))
TRIPLES = f"""{OBS}, triples AS (
    SELECT 'urn:obs:' || event_id AS s, '{PROPERTY}' AS p, 'urn:stream:' || stream AS o, 'iri' AS o_type FROM obs
    UNION ALL SELECT 'urn:obs:' || event_id, '{TS}', strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'dateTime' FROM obs
    UNION ALL SELECT 'urn:obs:' || event_id, '{VALUE}', CAST(value AS VARCHAR), 'double' FROM obs)"""


# --- A: sources, sinks, ingest


@query(f"WITH {TRIPLES} SELECT * FROM triples")
def observation_to_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_triples(obs(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT * FROM triples")
def ntriples_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_ntriples(S.to_lines(obs(spark, sf_dir)))


@query(f"WITH {OBS} SELECT 'urn:obs:' || event_id AS subject, 'urn:stream:' || stream AS property, ms, value FROM obs")
def observation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pivot_observations(S.parse_ntriples(S.to_ntriples(S.to_triples(obs(spark, sf_dir)), one_line=False)))


@query(f"WITH {PANES} SELECT stream, start_ms, end_ms, round(CASE WHEN start_ms // {PANE} % 3 = 0 THEN sum ELSE sum / count END, 8) AS value FROM panes WHERE start_ms // {PANE} % 5 <> 0")
def result_message_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir)
    n = F.floor(F.col("start_ms") / PANE)
    nested = F.to_json(F.struct(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end")).alias("window"), "sum"))
    flat = F.to_json(F.struct(F.col("start_ms").alias("window_start"), F.col("end_ms").alias("window_end"), "sum", (F.col("sum") / F.col("count")).alias("resultValue")))
    payload = F.when(n % 5 == 0, "not a message").when(n % 3 == 0, nested).otherwise(flat)
    good, _ = S.parse_result_messages(rows.select("stream", payload.alias("payload")))
    return rounded(good, "value").select("stream", "start_ms", "end_ms", "value")


# The bytes of a message, its numbers as text: sums are rounded first, so both sides write the same digits.
_JSON = """CASE form WHEN 'full' THEN '{{"window":{{"start":' || start_ms || ',"end":' || end_ms || '}},"count":' || count || ',"sum":' || sum || ',"min":' || min || ',"max":' || max || ',"avg":' || (sum / count)
    || ',"source_stream":"' || stream || '","range":{pane},"temporally_complete":' || (start_ms >= {origin} AND end_ms <= {mark}) || '}}' ELSE '{{"window":{{"start":' || start_ms || ',"end":' || end_ms || '}},"count":' || count || ',"sum":' || sum || '}}' END""".format(pane=PANE, origin=ANCHOR + 3 * HOUR, mark=ANCHOR + 600 * HOUR)


@query(
    f"""WITH {PANES}, m AS (SELECT stream, form, strlen({_JSON}) AS bytes FROM (SELECT * REPLACE (round(sum, 2) AS sum) FROM panes WHERE count > 0), (VALUES ('full'), ('compact')) f(form))
    SELECT stream AS topic, form, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS messages FROM m GROUP BY ALL"""
)
def result_message_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts = states(spark, sf_dir).where("count > 0").withColumn("sum", F.round("sum", 2)).withColumns({"coverage_origin": F.lit(ANCHOR + 3 * HOUR), "input_watermark": F.lit(ANCHOR + 600 * HOUR)}), []
    for form in (False, True):
        json = S.to_result_json(rows, compact=form)
        parts.append(json.select("topic", F.lit("compact" if form else "full").alias("form"), F.octet_length("payload").cast("long").alias("bytes")))
    return parts[0].unionByName(parts[1]).groupBy("topic", "form").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("messages"))


LOGGED = "CASE event_id % 3 WHEN 0 THEN 'recomposed window result=' || CAST(value AS DECIMAL(18, 2)) || ' chunk=' || event_id WHEN 1 THEN 'published value: ' || CAST(value AS DECIMAL(18, 2)) ELSE 'heartbeat' END"


@query(
    f"""WITH {OBS} SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) END AS result,
        CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS chunk FROM obs"""
)
def log_line_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = obs(spark, sf_dir).select("event_id", F.expr(LOGGED).alias("value"))
    patterns = {"result": [r"result=(-?[\d.]+)", r"published value: (-?[\d.]+)"], "chunk": [r"chunk=(\d+)"]}
    return S.extract_log_rows(lines, patterns).select("event_id", "result", "chunk")


@query(f"WITH {OBS} SELECT stream, count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS rejected FROM (SELECT stream, ms BETWEEN {ANCHOR + 24 * HOUR} AND {ANCHOR + 600 * HOUR} AS inside FROM obs) GROUP BY stream")
def domain_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.domain_filter(obs(spark, sf_dir), ANCHOR + 24 * HOUR, ANCHOR + 600 * HOUR)[1]


@query(
    f"""WITH {OBS}, b AS (SELECT *, (ms - min(ms) OVER (PARTITION BY stream)) // {HOUR} AS bucket FROM obs)
    SELECT stream, arg_min(event_id, (ms, event_id)) AS event_id, min(ms) AS ms, arg_min(value, (ms, event_id)) AS value FROM b GROUP BY stream, bucket"""
)
def downsample_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.downsample(obs(spark, sf_dir), HOUR).select("stream", "event_id", "ms", "value")


@query(
    f"""WITH {OBS}, span AS (SELECT stream, min(ms) AS a, max(ms) AS b FROM obs GROUP BY stream)
    SELECT event_id, stream, CAST(loop AS INTEGER) AS loop, 1000000 + loop * (b - a + 1) + ms - a AS ms
    FROM obs JOIN span USING (stream), unnest(range(3)) AS t(loop)"""
)
def replay_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rebase(obs(spark, sf_dir), 1_000_000, 3).select("event_id", "stream", "loop", "ms")


@query(
    f"""WITH {OBS}, t AS (SELECT stream, ms AS target, ms + (event_id * 7) % 5 AS actual FROM obs)
    SELECT stream, count(*) AS messages, round(avg(actual - target), 8) AS mean_lag_ms, round(quantile_cont(actual - target, 0.95), 8) AS p95_lag_ms,
           max(actual - target) AS max_lag_ms, round((max(target) - min(target)) / (max(actual) - min(actual)), 9) AS replay_speed FROM t GROUP BY stream"""
)
def publish_lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panemill.reports.traffic import publish_lag

    rows = obs(spark, sf_dir).select("stream", F.col("ms").alias("target_publish_time"), (F.col("ms") + (F.col("event_id") * 7) % 5).alias("actual_publish_time"))
    return rounded(publish_lag(rows, ["stream"]), "mean_lag_ms", "p95_lag_ms").withColumn("replay_speed", F.round("replay_speed", 9))


UNIFORM = "((CAST('0x' || substr(md5(concat_ws(':', 7, event_id, nth, '{0}')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0)"


@query(
    f"""WITH {OBS}, n AS (SELECT *, [0.1, 0.5, 1.0][nth + 1]::DOUBLE AS sigma FROM obs, unnest(range(3)) AS t(nth))
    SELECT event_id, sigma, round(value + sigma * sqrt(-2 * ln{UNIFORM.format('r')}) * cos(2 * pi() * {UNIFORM.format('a')}), 6) AS value FROM n"""
)
def noise_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.add_noise(obs(spark, sf_dir), "value", [0.1, 0.5, 1.0], seed=7).select("event_id", "sigma", F.round("value", 6).alias("value"))


@query(f"WITH {OBS} SELECT event_id, row_number() OVER (ORDER BY ms, event_id) AS place FROM obs")
def sorted_at_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written in the order of time, read again and numbered."""
    path = shared_folder(spark, "sorted")
    S.write_sorted(obs(spark, sf_dir), path)
    return S.in_order(spark.read.parquet(path)).select("event_id", "place")


@query(f"WITH {OBS} SELECT stream AS topic, event_id % 3 = 0 AS broken, count(*) AS rows, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE ms END) AS BIGINT) AS total FROM obs GROUP BY ALL")
def json_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic logs written as lines of JSON, every third cut short, and read by their schema."""
    path = shared_folder(spark, "log")
    line = F.to_json(F.struct(F.col("ms").alias("timestamp"), F.col("stream").alias("topic"), F.lit(7).cast("long").alias("published_bytes")))
    cut = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("stream"))).otherwise(line)
    obs(spark, sf_dir).select(cut.alias("value")).write.text(path)
    good, bad = read_json_log(spark, path)
    rows = good.select("topic", F.lit(False).alias("broken"), "timestamp").unionByName(bad.select(F.substring("value", 2, 99).alias("topic"), F.lit(True).alias("broken"), F.lit(0).cast("long").alias("timestamp")))
    return rows.groupBy("topic", "broken").agg(F.count(F.lit(1)).alias("rows"), F.sum("timestamp").alias("total"))


# --- B, C: relational


@query(f"WITH {TRIPLES} SELECT v.s, p.o AS property, v.o AS value FROM triples p JOIN triples v ON p.s = v.s AND p.p = '{PROPERTY}' AND v.p = '{VALUE}' WHERE p.o = 'urn:stream:click'")
def bgp_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.star_join(S.to_triples(obs(spark, sf_dir)), {"property": PROPERTY, "value": VALUE}, having={"property": "urn:stream:click"})
    return rows.select("s", "property", "value")


@query(f"WITH {WINS} SELECT stream, win_start, win_end, round(avg(value), 8) AS mean, round(sum(value), 8) AS total, count(value) AS n, count(*) AS n_all, min(value) AS lo, max(value) AS hi FROM wins GROUP BY ALL")
def multi_agg_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [("avg", "mean"), ("sum", "total"), ("count", "n"), ("count_all", "n_all"), ("min", "lo"), ("max", "hi"), ("max", "hi")]
    return rounded(W.window_agg(obs(spark, sf_dir), SPEC, aggs), "mean", "total")


@query(f"WITH {WINS} SELECT stream, win_start, win_end, round(avg(value), 8) AS avg, count(value) AS count FROM wins WHERE value > 10 AND sensor < 100 GROUP BY ALL")
def window_agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.window_agg(obs(spark, sf_dir).where("value > 10 and sensor < 100"), SPEC, ["avg", "count"]), "avg")


@query(f"WITH {OBS} SELECT event_id, round(sqrt(value), 9) AS root, round(pow(value, 2), 8) AS square, CAST(floor(value) AS BIGINT) AS whole FROM obs")
def scalar_sqrt_pow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    return rows.select("event_id", F.round(F.sqrt("value"), 9).alias("root"), F.round(F.pow("value", F.lit(2)), 8).alias("square"), F.floor("value").alias("whole"))


@query(f"WITH {OBS} SELECT DISTINCT o.stream, o.sensor, v.label FROM obs o JOIN (VALUES ('click', 'a'), ('view', 'b')) v(stream, label) USING (stream)")
def values_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline = spark.createDataFrame([("click", "a"), ("view", "b")], "stream string, label string")
    return obs(spark, sf_dir).join(F.broadcast(inline), "stream").select("stream", "sensor", "label").distinct()


@query(f"WITH {OBS} SELECT event_id, value, ms FROM obs ORDER BY value DESC, event_id LIMIT 50")
def top_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", "value", "ms").orderBy(F.desc("value"), "event_id").limit(50)


@query(f"WITH {PANES} SELECT stream, start_ms, end_ms, count AS n, round(sum / count, 8) AS mean, round(sum, 8) AS total FROM panes")
def project_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.project_state(states(spark, sf_dir), [("count", "n"), ("avg", "mean"), ("sum", "total")]), "mean", "total")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sensor"), "c_nationkey", "c_mktsegment")


CUST = "cust AS (SELECT c_custkey AS sensor, c_nationkey, c_mktsegment FROM customer)"


@query(f"WITH {OBS}, {CUST} SELECT event_id, sensor, c_nationkey, c_mktsegment, value FROM obs JOIN cust USING (sensor)")
def static_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.enrich(obs(spark, sf_dir), customers(spark, sf_dir), ["sensor"]).select("event_id", "sensor", "c_nationkey", "c_mktsegment", "value")


@query(f"WITH {OBS}, {CUST} SELECT event_id, sensor, c_mktsegment FROM obs LEFT JOIN (SELECT * FROM cust WHERE c_nationkey < 10) USING (sensor)")
def static_enrich_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.enrich(obs(spark, sf_dir), customers(spark, sf_dir).where("c_nationkey < 10"), ["sensor"], "left").select("event_id", "sensor", "c_mktsegment")


@query(f"WITH {OBS}, {CUST} SELECT event_id, sensor FROM obs WHERE sensor NOT IN (SELECT sensor FROM cust WHERE c_mktsegment = 'BUILDING')")
def static_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.enrich(obs(spark, sf_dir), customers(spark, sf_dir).where("c_mktsegment = 'BUILDING'"), ["sensor"], "left_anti").select("event_id", "sensor")


# --- E: windows

for _agg in ("avg", "sum", "count", "min", "max"):
    _value = "round({0}(value), 8)" if _agg in ("avg", "sum") else "{0}(value)"

    @query(f"WITH {WINS} SELECT stream, win_start, win_end, {_value.format(_agg)} AS {_agg} FROM wins GROUP BY ALL", name=f"sliding_window_{_agg}")
    def _sliding(spark: SparkSession, sf_dir: str, agg: str = _agg) -> DataFrame:
        rows = W.window_agg(obs(spark, sf_dir), SPEC, [agg])
        return rounded(rows, agg) if agg in ("avg", "sum") else rows

    @query(f"WITH {REC} SELECT stream, win_start, win_end, panes, {'round({0}, 8)'.format(_agg) if _agg in ('avg', 'sum') else _agg} AS {_agg} FROM rec", name=f"recompose_{_agg}")
    def _recompose(spark: SparkSession, sf_dir: str, agg: str = _agg) -> DataFrame:
        rows = P.recompose(states(spark, sf_dir), SPEC, PANE).select("stream", "win_start", "win_end", "panes", agg)
        return rounded(rows, agg) if agg in ("avg", "sum") else rows


ALL = "count(value) AS count, round(sum(value), 8) AS sum, round(avg(value), 8) AS avg, min(value) AS min, max(value) AS max"


@query(f"WITH {OBS} SELECT stream, ms // {6 * HOUR} * {6 * HOUR} AS win_start, ms // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} AS win_end, {ALL} FROM obs GROUP BY ALL")
def tumbling_window_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.tumbling_agg(obs(spark, sf_dir), 6 * HOUR, ["count", "sum", "avg", "min", "max"]), "sum", "avg")


GAP = WindowSpec(HOUR, 3 * HOUR)


@query(f"WITH {OBS} SELECT stream, ms // {3 * HOUR} * {3 * HOUR} AS win_start, ms // {3 * HOUR} * {3 * HOUR} + {HOUR} AS win_end, count(value) AS count FROM obs WHERE ms % {3 * HOUR} < {HOUR} GROUP BY ALL")
def gap_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_agg(obs(spark, sf_dir), GAP, ["count"])


ORIGIN = 1_704_000_123_543


@query(f"WITH {OBS} SELECT event_id, win_start, win_start + {6 * HOUR} AS win_end FROM (SELECT event_id, {ORIGIN} + (ms - {ORIGIN}) // {PANE} * {PANE} AS win_start FROM obs)")
def origin_aligned_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = align_start(F.col("ms"), PANE, ORIGIN)
    return obs(spark, sf_dir).select("event_id", start.alias("win_start"), (start + 6 * HOUR).alias("win_end"))


@query(f"WITH {WINS} SELECT stream, win_start, win_end, min(ms) AS first_ms, max(ms) AS last_ms FROM wins GROUP BY ALL")
def window_event_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.assign_windows(obs(spark, sf_dir), SPEC)
    return rows.groupBy("stream", "win_start", "win_end").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query(f"WITH {WINS} SELECT win_start, win_end, {ALL} FROM wins WHERE stream IN ('click', 'view') GROUP BY ALL")
def union_stream_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    parts = [rows.where(F.col("stream") == s) for s in ("click", "view")]
    return rounded(W.union_window_agg(parts, SPEC, ["count", "sum", "avg", "min", "max"]), "sum", "avg")


SPECS = [("q1", 4, 2), ("q2", 6, 2), ("q3", 8, 4), ("q4", 12, 8), ("q5", 24, 12)]
SPEC_ROWS = ", ".join(f"('{i}', {r * HOUR}, {s * HOUR})" for i, r, s in SPECS)
MULTI = f"specs(id, range_ms, step_ms) AS (VALUES {SPEC_ROWS})"


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r * HOUR, s * HOUR) for i, r, s in SPECS], "id string, range_ms long, step_ms long")


BY_SPEC = "unnest(range({0} // step_ms * step_ms - (range_ms - 1) // step_ms * step_ms, {0} // step_ms * step_ms + 1, step_ms)) AS t(w)"


@query(f"WITH {OBS}, {MULTI} SELECT id, stream, w AS win_start, w + range_ms AS win_end, round(avg(value), 8) AS avg, count(value) AS count FROM obs, specs, {BY_SPEC.format('ms')} WHERE w + range_ms > ms GROUP BY id, stream, w, range_ms")
def multi_spec_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.multi_spec_agg(obs(spark, sf_dir), specs(spark), ["avg", "count"]), "avg")


@query(f"WITH {OBS}, {MULTI} SELECT id, stream, w AS win_start, w + range_ms AS win_end, round(avg(value), 8) AS avg, count(value) AS count, round(sum(value), 8) AS sum, min(value) AS min, max(value) AS max FROM obs, specs, {BY_SPEC.format('ms')} WHERE w + range_ms > ms GROUP BY id, stream, w, range_ms")
def derived_original_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.derive_original(states(spark, sf_dir), specs(spark), PANE), "avg", "sum")


@query(f"WITH {WINS} SELECT stream, win_start, win_end, {ALL} FROM wins GROUP BY ALL")
def exact_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.exact_baseline(obs(spark, sf_dir), SPEC), "sum", "avg")


SPAN = f"spans AS (SELECT stream, sensor, ms // {6 * HOUR} AS bundle, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS count FROM obs GROUP BY ALL)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).groupBy("stream", "sensor", F.floor(F.col("ms") / (6 * HOUR)).alias("bundle"))
    return rows.agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("count"))


@query(
    f"""WITH {OBS}, {SPAN}, i AS (SELECT *, greatest(0, CAST(floor((first_ms - {ANCHOR}) / {PANE}) AS BIGINT)) AS win_index FROM spans)
    SELECT stream, sensor, bundle, win_index, {ANCHOR} + win_index * {PANE} AS win_start, {ANCHOR} + win_index * {PANE} + {6 * HOUR} AS win_end,
           last_ms - first_ms >= {6 * HOUR - 1000} AS complete FROM i"""
)
def logical_window_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.logical_windows(_spans(spark, sf_dir).withColumn("anchor", F.lit(ANCHOR)), SPEC)
    return rows.select("stream", "sensor", "bundle", "win_index", "win_start", "win_end", "complete")


@query(
    f"""WITH {WINS}, w AS (SELECT stream, win_start, CASE WHEN win_start // {PANE} % 97 = 0 THEN win_start ELSE win_end END AS win_end, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS count FROM wins GROUP BY ALL)
    SELECT stream, win_start, win_end, 16.0::DOUBLE AS expected_count, 2.0::DOUBLE AS allowed_missing,
           CASE WHEN NOT win_end > win_start THEN 'invalid_window_bounds' WHEN last_ms - first_ms < {SPEC.range_ms - 1_200_000} THEN 'incomplete_span'
                WHEN count < 14 THEN 'incomplete_count' ELSE 'complete' END AS status FROM w"""
)
def window_completeness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_event_span(spark, sf_dir).join(W.window_agg(obs(spark, sf_dir), SPEC, [("count_all", "count")]), ["stream", "win_start", "win_end"])
    rows = rows.withColumn("win_end", F.when(F.floor(F.col("win_start") / PANE) % 97 == 0, F.col("win_start")).otherwise(F.col("win_end")))
    return W.completeness(rows, F.lit(16.0), SPEC, 1_200_000).select("stream", "win_start", "win_end", "expected_count", "allowed_missing", "status")


NUMBERED = f"CASE WHEN win_start >= {ANCHOR} THEN (win_start - {ANCHOR}) // {PANE} + 1 END"


@query(f"WITH {WINS}, g AS (SELECT stream, win_start, win_end, count(value) AS count, max(ms) - min(ms) AS span FROM wins GROUP BY ALL) SELECT stream, win_start, {NUMBERED} AS window_number, count, span >= {4 * HOUR} AND win_end - win_start = {SPEC.range_ms} AS comparable FROM g")
def window_number_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.assign_windows(obs(spark, sf_dir), SPEC).groupBy("stream", "win_start", "win_end").agg(F.count("value").alias("count"), F.min("ms").alias("a"), F.max("ms").alias("b"))
    whole = W.comparable(*map(F.col, ("a", "b", "win_start", "win_end")), SPEC, 4 * HOUR)
    return W.numbered(rows, ANCHOR, SPEC).select("stream", "win_start", "window_number", "count", whole.alias("comparable"))


@query(f"WITH {WINS}, g AS (SELECT stream, win_start, {NUMBERED} AS window_number, count(value) AS count FROM wins GROUP BY ALL) SELECT * FROM g WHERE window_number <= 50")
def window_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.window_agg(obs(spark, sf_dir), SPEC, ["count"])
    return W.first_windows(W.numbered(rows, ANCHOR, SPEC), 50).select("stream", "win_start", "window_number", "count")


@query(
    f"""WITH {PANES} SELECT (start_ms - {ANCHOR}) // {PANE} + 1 AS window_number, count(DISTINCT stream) AS streams, CAST(sum(count) AS BIGINT) AS count, round(sum(sum), 8) AS sum, min(min) AS min, max(max) AS max,
        round(sum(sum) / sum(count), 8) AS avg FROM panes GROUP BY 1 HAVING count(DISTINCT stream) >= 4"""
)
def cross_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir).withColumn("window_number", (F.col("start_ms") - ANCHOR).cast("long") / PANE + 1).withColumn("window_number", F.col("window_number").cast("long"))
    late = rows.withColumn("sum", F.col("sum") * 2)  # each stream reports twice; the first report counts
    twice = rows.withColumn("arrived", F.lit(1)).unionByName(late.withColumn("arrived", F.lit(2)))
    return rounded(W.merge_streams(twice, 4, ["arrived"]), "sum", "avg").select("window_number", "streams", "count", "sum", "min", "max", "avg")


@query(f"WITH {WINS} SELECT stream, sensor, win_start, win_end, count(value) AS count, round(avg(value), 8) AS avg FROM wins GROUP BY ALL HAVING count(value) >= 3")
def window_group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.window_agg(obs(spark, sf_dir), SPEC, ["count", "avg"], ["stream", "sensor"]).where("count >= 3"), "avg")


# --- J1, J2: relation to stream

SETS = f"{WINS}, w AS (SELECT DISTINCT stream, win_start, win_end, sensor FROM wins)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.assign_windows(obs(spark, sf_dir), SPEC).select("stream", "win_start", "win_end", "sensor").distinct()


_SAME = "x.stream = w.stream AND x.sensor = w.sensor"
for _mode, _sql in {
    "rstream": f"WITH {SETS} SELECT * FROM w",
    "istream": f"WITH {SETS} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.win_start = w.win_start - {PANE} AND {_SAME})",
    "dstream": f"""WITH {SETS} SELECT stream, win_start + {PANE} AS win_start, win_end + {PANE} AS win_end, sensor FROM w WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.win_start = w.win_start + {PANE} AND {_SAME})
        AND EXISTS (SELECT 1 FROM w x WHERE x.win_start = w.win_start + {PANE})""",
}.items():

    @query(_sql, name=_mode)
    def _r2s(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return W.relation_to_stream(_members(spark, sf_dir), SPEC, mode, ["stream", "sensor"]).select("stream", "win_start", "win_end", "sensor")


# --- F: panes


@query("WITH r AS (SELECT o_orderkey % 50 AS g, (1 + o_orderkey % 4) * 3600000 AS x FROM orders) SELECT g, CASE WHEN bool_and(x % 14400000 = 0) THEN 14400000 WHEN bool_and(x % 7200000 = 0) THEN 7200000 WHEN bool_and(x % 10800000 = 0) THEN 10800000 ELSE 3600000 END AS pane_ms FROM r GROUP BY g")
def chunk_size_gcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panemill.plans.reuse import gcd_column

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select((F.col("o_orderkey") % 50).alias("g"), ((1 + F.col("o_orderkey") % 4) * HOUR).alias("x"))
    return rows.groupBy("g").agg(F.collect_set("x").alias("xs")).select("g", gcd_column(F.col("xs")).alias("pane_ms"))


@query(
    """WITH x AS (SELECT DISTINCT o_orderkey % 50 AS g, (1 + o_orderkey % 6) * 3600000 AS x FROM orders), l AS (SELECT g, list_sort(list(x)) AS xs FROM x GROUP BY g)
    SELECT g, CAST(list_reduce(xs, lambda a, b: gcd(a, b)) AS BIGINT) AS step_ms, CAST(list_reduce(xs, lambda a, b: lcm(a, b)) AS BIGINT) AS lcm_ms, CAST(list_max(xs) AS BIGINT) AS width_ms FROM l"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of groups of ranges: the pane step, the time after which their windows begin together, and the widest range."""
    from panemill.plans.reuse import gcd_column, lcm_column

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select((F.col("o_orderkey") % 50).alias("g"), ((1 + F.col("o_orderkey") % 6) * HOUR).alias("x")).groupBy("g").agg(F.collect_set("x").alias("xs"))  # six values at most
    return rows.select("g", gcd_column(F.col("xs")).alias("step_ms"), lcm_column(F.col("xs")).alias("lcm_ms"), F.greatest(gcd_column(F.col("xs")), F.array_max("xs")).alias("width_ms"))


@query(f"WITH {PANES} SELECT stream, start_ms, end_ms, count, round(sum, 8) AS sum, min, max FROM panes")
def chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states(spark, sf_dir), "sum")


@query(f"WITH {PANES} SELECT start_ms, end_ms, CAST(sum(count) AS BIGINT) AS count, round(sum(sum), 8) AS sum, min(min) AS min, max(max) AS max FROM panes GROUP BY ALL")
def chunk_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir).withColumn("avg", F.col("sum") / F.col("count"))
    return rounded(P.merge_producers(rows.withColumn("sum", F.when(F.col("stream") != "view", F.col("sum")))), "sum")


@query(f"WITH {PANES} SELECT stream, CAST(sum(count) AS BIGINT) AS count, round(sum(sum), 8) AS sum, min(min) AS min, max(max) AS max, round(sum(sum) / sum(count), 8) AS avg FROM panes GROUP BY stream")
def recompute_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.recompose_flat(states(spark, sf_dir), ["stream"]), "sum", "avg")


@query(f"WITH {PANES}, s AS (SELECT stream, start_ms, CASE WHEN start_ms // {PANE} % 3 > 0 THEN sum END AS sum, CASE WHEN start_ms // {PANE} % 4 > 0 THEN count END AS count, min, max FROM panes) SELECT stream, start_ms, sum IS NOT NULL AND count IS NOT NULL AS avg_ok, sum IS NOT NULL AS sum_ok, count IS NOT NULL AS count_ok, min IS NOT NULL AS min_ok, max IS NOT NULL AS max_ok FROM s")
def state_recomposable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("start_ms") / PANE)
    rows = states(spark, sf_dir).withColumn("sum", F.when(n % 3 > 0, F.col("sum"))).withColumn("count", F.when(n % 4 > 0, F.col("count")))
    return rows.select("stream", "start_ms", *(P.recomposable(a).alias(f"{a}_ok") for a in ("avg", "sum", "count", "min", "max")))


@query(f"WITH {PANES} SELECT stream, start_ms, win_start, win_end FROM ({sliding('panes', 'start_ms')})")
def chunk_to_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunks_to_windows(states(spark, sf_dir), SPEC, PANE).select("stream", "start_ms", "win_start", "win_end")


GAPS = f"""{PANES}, gappy AS (
    SELECT stream, start_ms, CASE WHEN start_ms // {PANE} % 13 = 0 THEN 0 WHEN start_ms // {PANE} % 11 = 0 THEN NULL ELSE count END AS count,
           CASE WHEN start_ms // {PANE} % 13 = 0 OR start_ms // {PANE} % 7 = 0 THEN NULL ELSE sum END AS sum,
           CASE WHEN start_ms // {PANE} % 13 <> 0 AND start_ms // {PANE} % 14 = 0 THEN sum / count END AS avg,
           CASE WHEN start_ms // {PANE} % 13 <> 0 AND start_ms // {PANE} % 9 > 0 THEN min END AS min, CASE WHEN start_ms // {PANE} % 13 <> 0 THEN max END AS max FROM panes),
filled AS (SELECT stream, start_ms, count, CASE WHEN sum IS NULL THEN avg * count ELSE sum END AS sum, min, max, count IS NOT DISTINCT FROM 0 AS empty FROM gappy)"""
_WHOLE = "CASE WHEN bool_or({0} IS NULL AND NOT empty) THEN NULL ELSE {1} END"


@query(
    f"""WITH {GAPS}, m AS (SELECT stream, win_start, win_end, count(*) AS panes, CASE WHEN bool_or(count IS NULL) THEN NULL ELSE CAST(sum(count) AS BIGINT) END AS count,
        {_WHOLE.format('sum', 'sum(sum)')} AS sum, {_WHOLE.format('min', 'min(min)')} AS min, {_WHOLE.format('max', 'max(max)')} AS max FROM ({sliding('filled', 'start_ms')}) GROUP BY ALL)
    SELECT stream, win_start, win_end, panes, count, round(sum, 8) AS sum, min, max, round(CASE WHEN count > 0 THEN sum / count END, 8) AS avg FROM m"""
)
def recompose_incomplete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over states that lack sums, counts or extremes: such a state makes null what it can't support, unless it is empty or has an average."""
    n = F.floor(F.col("start_ms") / PANE)
    rows = states(spark, sf_dir).withColumn("avg", F.when((n % 13 != 0) & (n % 14 == 0), F.col("sum") / F.col("count")))
    rows = rows.withColumn("sum", F.when((n % 13 != 0) & (n % 7 != 0), F.col("sum"))).withColumn("min", F.when((n % 13 != 0) & (n % 9 > 0), F.col("min"))).withColumn("max", F.when(n % 13 != 0, F.col("max")))
    rows = rows.withColumn("count", F.when(n % 13 == 0, F.lit(0).cast("long")).when(n % 11 != 0, F.col("count")))
    return rounded(P.recompose(rows, SPEC, PANE), "sum", "avg")


FINE = 600_000
WIDE = WindowSpec(72 * HOUR, 3 * FINE, 2 * FINE)
_NTH = f"(start_ms // {FINE})"
FINE_GAPS = f"""{OBS}, fine AS (SELECT stream, ms // {FINE} * {FINE} AS start_ms, count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max FROM obs GROUP BY ALL),
patchy AS (SELECT stream, start_ms, CASE WHEN {_NTH} % 499 = 0 THEN 0 WHEN {_NTH} % 997 = 0 THEN NULL ELSE count END AS count, CASE WHEN {_NTH} % 499 > 0 AND {_NTH} % 1009 > 0 THEN sum END AS sum,
    CASE WHEN {_NTH} % 499 > 0 AND {_NTH} % 1013 > 0 THEN min END AS min, CASE WHEN {_NTH} % 499 > 0 THEN max END AS max, coalesce(count = 0, false) OR {_NTH} % 499 = 0 AS empty FROM fine WHERE {_NTH} % 5 <> 0)"""


def _patchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of ten minutes with gaps, of which some lack counts, sums or extremes, or are empty."""
    n = F.floor(F.col("start_ms") / FINE)
    rows = P.chunk_states(obs(spark, sf_dir), FINE).where(n % 5 != 0)
    rows = rows.withColumn("count", F.when(n % 499 == 0, F.lit(0).cast("long")).when(n % 997 != 0, F.col("count"))).withColumn("sum", F.when((n % 499 > 0) & (n % 1009 > 0), F.col("sum")))
    return rows.withColumn("min", F.when((n % 499 > 0) & (n % 1013 > 0), F.col("min"))).withColumn("max", F.when(n % 499 > 0, F.col("max")))


def _from_patchy(columns: str, starts: str, keys: str) -> str:
    return f"""m AS (SELECT {keys}, count(*) AS panes, CASE WHEN bool_or(count IS NULL) THEN NULL ELSE CAST(sum(count) AS BIGINT) END AS count,
        {_WHOLE.format('sum', 'sum(sum)')} AS sum, {_WHOLE.format('min', 'min(min)')} AS min, {_WHOLE.format('max', 'max(max)')} AS max FROM {starts} GROUP BY ALL)
    SELECT {columns}, count, round(sum, 8) AS sum, min, max, round(CASE WHEN count > 0 THEN sum / count END, 8) AS avg FROM m"""


def _starts(r: str, s: str, o: str) -> str:
    return f"unnest(range((start_ms - {o}) // {s} * {s} + {o} - ({r} - 1) // {s} * {s}, (start_ms - {o}) // {s} * {s} + {o} + 1, {s})) AS t(w)"


@query(
    f"""WITH {FINE_GAPS}, w AS (SELECT stream, w AS win_start, w + {WIDE.range_ms} AS win_end, count, sum, min, max, empty FROM patchy, {_starts(str(WIDE.range_ms), str(WIDE.step_ms), str(WIDE.origin_ms))} WHERE w + {WIDE.range_ms} > start_ms),
    {_from_patchy('stream, win_start, win_end, panes', 'w', 'stream, win_start, win_end')}"""
)
def recompose_wide_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days over panes of ten minutes."""
    return rounded(P.recompose(_patchy(spark, sf_dir), WIDE, FINE), "sum", "avg")


MIXED = [("short", 30 * 60_000, 30 * 60_000, 0), ("day", 24 * HOUR, HOUR, 20 * 60_000), ("gap", HOUR, 3 * HOUR, 10 * 60_000), ("week", 168 * HOUR, 6 * HOUR, 50 * 60_000), ("odd", 70 * 60_000, 10 * 60_000, -40 * 60_000)]
MIXED_ROWS = f"specs(id, r, s, o) AS (VALUES {', '.join(map(str, MIXED))})"


@query(
    f"""WITH {FINE_GAPS}, {MIXED_ROWS}, w AS (SELECT id, stream, w AS win_start, w + r AS win_end, count, sum, min, max, empty FROM patchy, specs, {_starts('r', 's', 'o')} WHERE w + r > start_ms AND w <= start_ms),
    {_from_patchy('id, stream, win_start, win_end', 'w', 'id, stream, win_start, win_end')}"""
)
def derived_mixed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five specifications with origins, of thirty minutes to a week, from the same patchy states."""
    table = spark.createDataFrame(MIXED, "id string, range_ms long, step_ms long, origin_ms long")
    return rounded(P.derive_original(_patchy(spark, sf_dir), table, FINE), "sum", "avg")


@query(
    f"""WITH {FINE_GAPS}, {MIXED_ROWS} SELECT id, stream, w AS win_start, w + r AS win_end, count(value) AS count, round(avg(value), 8) AS avg
    FROM obs, specs, {_starts('r', 's', 'o').replace('start_ms', 'ms')} WHERE w + r > ms AND w <= ms GROUP BY ALL"""
)
def multi_spec_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same specifications straight from the observations, in one pass."""
    table = spark.createDataFrame(MIXED, "id string, range_ms long, step_ms long, origin_ms long")
    return rounded(W.multi_spec_agg(obs(spark, sf_dir), table, ["count", "avg"]), "avg")


KEYS = f"list_transform(range(win_start, win_end, {PANE}), lambda s: s || ':' || (s + {PANE}))"


@query(f"WITH {REC} SELECT stream, win_start, array_to_string({KEYS}, ',') AS keys, CAST(3 AS INTEGER) AS n FROM rec")
def expected_chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.recompose(states(spark, sf_dir), SPEC, PANE)
    keys = P.expected_keys(F.col("win_start"), F.col("win_end"), PANE)
    return rows.select("stream", "win_start", F.concat_ws(",", keys).alias("keys"), F.size(keys).alias("n"))


THIN = f"{PANES}, thin AS (SELECT * FROM panes WHERE (start_ms // {PANE} + length(stream)) % 5 <> 0), twice AS (SELECT * FROM thin UNION ALL SELECT * FROM thin WHERE start_ms // {PANE} % 7 = 0)"


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("start_ms") / PANE)
    return states(spark, sf_dir).where((n + F.length("stream")) % 5 != 0)


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = _thin(spark, sf_dir)
    return thin.unionByName(thin.where(F.floor(F.col("start_ms") / PANE) % 7 == 0))


COVER = f"{THIN}, c AS (SELECT stream, win_start, win_end, count(DISTINCT start_ms) AS received, count(*) - count(DISTINCT start_ms) AS duplicates FROM ({sliding('twice', 'start_ms')}) GROUP BY ALL)"


@query(f"WITH {COVER} SELECT stream, win_start, win_end, received, 3 - received AS missing, duplicates, received = 3 AS complete FROM c")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.coverage(_twice(spark, sf_dir), SPEC, PANE)
    sizes = [F.size(c).cast("long").alias(c) for c in ("received", "missing", "duplicates")]
    return rows.select("stream", "win_start", "win_end", *sizes, "complete")


@query(f"WITH {COVER} SELECT win_start, win_end, count(*) AS producers, CAST(sum(received) AS BIGINT) AS received, CAST(sum(3 - received) AS BIGINT) AS missing, bool_and(received = 3) AS complete FROM c GROUP BY ALL")
def emission_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.emission_proof(_twice(spark, sf_dir), SPEC, PANE, "stream")
    total = lambda c: F.sum(F.size(c)).cast("long").alias(c)
    return rows.groupBy("win_start", "win_end").agg(F.count(F.lit(1)).alias("producers"), total("received"), total("missing"), F.bool_and("complete").alias("complete"))


@query(f"WITH {COVER} SELECT win_start, count(*) AS producers, CAST(sum(duplicates) AS BIGINT) AS duplicates, string_agg(stream || ':' || received, ',' ORDER BY stream) AS received FROM c GROUP BY ALL")
def emission_proof_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same proofs with all producers of a window in one row."""
    rows = P.proof_maps(P.emission_proof(_twice(spark, sf_dir), SPEC, PANE, "stream"), "stream")
    sizes = F.transform(F.array_sort(F.map_keys("received")), lambda k: F.concat(k, F.lit(":"), F.size(F.element_at("received", k))))
    twice = F.aggregate(F.map_values("duplicates"), F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return rows.select("win_start", "producers", twice.alias("duplicates"), F.array_join(sizes, ",").alias("received"))


@query(f"WITH {THIN} SELECT start_ms, end_ms, count(DISTINCT stream) AS producers FROM thin GROUP BY ALL HAVING count(DISTINCT stream) >= 4")
def pane_all_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.all_producers(_thin(spark, sf_dir), "stream", 4)


@query(
    f"""WITH {THIN}, f AS (SELECT *, CASE WHEN lag(end_ms) OVER o = start_ms THEN 0 ELSE 1 END AS fresh FROM thin WINDOW o AS (PARTITION BY stream ORDER BY start_ms)),
    r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY stream ORDER BY start_ms) AS BIGINT) AS run FROM f)
    SELECT stream, run, min(start_ms) AS run_start, max(end_ms) AS run_end, count(*) AS panes FROM r GROUP BY ALL"""
)
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.contiguous_runs(_thin(spark, sf_dir))


@query(f"WITH {PANES} SELECT stream, start_ms, end_ms, round(sum, 8) AS sum, count, CAST(1 + (start_ms // {PANE}) % 3 AS BIGINT) AS contributions FROM panes")
def dedupe_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("start_ms") / PANE) % 3))
    rows = rows.select("*", copies.alias("arrival")).withColumn("sum", F.col("sum") * (1 + F.col("arrival")))
    return rounded(P.dedupe_contributions(rows, ["stream", "start_ms", "end_ms"], "arrival"), "sum").select("stream", "start_ms", "end_ms", "sum", "count", "contributions")


@query(f"WITH {PANES}, m AS (SELECT *, max(end_ms) OVER () AS top FROM panes) SELECT stream, start_ms, end_ms, count FROM m WHERE start_ms >= {ANCHOR + 3 * HOUR} AND top - {5 * HOUR} >= end_ms")
def temporally_complete_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir)
    seen = rows.agg((F.max("end_ms") - 5 * HOUR).alias("input_watermark"))
    rows = rows.join(F.broadcast(seen)).withColumn("coverage_origin", F.lit(ANCHOR + 3 * HOUR)).withColumn("claims_complete", F.lit(True))
    return P.temporally_complete(rows)[0].select("stream", "start_ms", "end_ms", "count")


@query(f"WITH {PANES}, m AS (SELECT *, max(end_ms) OVER () AS top, start_ms // {PANE} % 4 <> 1 AS claims FROM panes) SELECT stream, start_ms, end_ms, count FROM m WHERE claims AND NOT (start_ms >= {ANCHOR + 3 * HOUR} AND top - {5 * HOUR} >= end_ms)")
def falsely_complete_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that claim to be complete although their panes weren't watched whole."""
    rows = states(spark, sf_dir)
    seen = rows.agg((F.max("end_ms") - 5 * HOUR).alias("input_watermark"))
    claims = F.floor(F.col("start_ms") / PANE) % 4 != 1
    rows = rows.join(F.broadcast(seen)).withColumn("coverage_origin", F.lit(ANCHOR + 3 * HOUR)).withColumn("claims_complete", claims)
    return P.temporally_complete(rows)[1].select("stream", "start_ms", "end_ms", "count")


_SAID = """CASE event_id % 8 WHEN 0 THEN '_:b' || event_id || ' <urn:p> "é\\u00e9\\U0001F600 \\"x\\" \\\\ y"@en-GB .' WHEN 1 THEN '# <urn:a> <urn:b> <urn:c> .' WHEN 2 THEN '<urn:s' || event_id || '> <urn:p> _:o . # <urn:a> <urn:b> <urn:c> .'
    WHEN 3 THEN '<urn:s' || event_id || '><urn:p>"1e20"^^<urn:type>.' WHEN 4 THEN 'no triple ' || event_id WHEN 5 THEN '<urn:s' || event_id || '> <urn:p> "plain" . <urn:t' || event_id || '> <urn:q> "tab\\tend" .' WHEN 6 THEN '<urn:s' || event_id || '> <urn:p> "open .' ELSE '' END"""


@query(
    f"""WITH {OBS}, e AS (SELECT event_id, event_id % 8 AS k FROM obs)
    SELECT '_:b' || event_id AS s, 'urn:p' AS p, 'éé😀 "x" \\ y' AS o, '@en-GB' AS o_type FROM e WHERE k = 0 UNION ALL SELECT 'urn:s' || event_id, 'urn:p', '_:o', 'blank' FROM e WHERE k = 2
    UNION ALL SELECT 'urn:s' || event_id, 'urn:p', '1e20', 'urn:type' FROM e WHERE k = 3 UNION ALL SELECT 'urn:s' || event_id, 'urn:p', 'plain', 'string' FROM e WHERE k = 5
    UNION ALL SELECT 'urn:t' || event_id, 'urn:q', 'tab' || chr(9) || 'end', 'string' FROM e WHERE k = 5"""
)
def ntriples_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes, languages, datatypes, escapes, comments and several triples a line."""
    return S.parse_ntriples(obs(spark, sf_dir).select(F.expr(_SAID.replace("\\", "\\\\")).alias("value")))


@query(f"WITH {OBS} SELECT event_id FROM obs WHERE event_id % 8 IN (4, 6)")
def ntriples_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with anything but triples and comments."""
    return S.rejected_ntriples(obs(spark, sf_dir).select("event_id", F.expr(_SAID.replace("\\", "\\\\")).alias("value"))).select("event_id")


@query(f"WITH {PANES} SELECT stream, start_ms AS win_start, start_ms + {SPEC.range_ms} AS win_end, end_ms AS seen_to, count, round(sum / count, 8) AS avg, false AS comparable FROM panes")
def early_partial_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.early_partial(states(spark, sf_dir), SPEC, PANE)
    return rounded(rows, "avg").select("stream", "win_start", "win_end", "seen_to", "count", "avg", "comparable")


@query(f"WITH {PANES} SELECT stream, round(sum(sum / count * count) / sum(count), 8) AS avg, CAST(sum(count) AS BIGINT) AS count FROM panes GROUP BY stream")
def weighted_avg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.weighted_merge(states(spark, sf_dir).withColumn("value", F.col("sum") / F.col("count")), ["stream"]), "avg")


def _grown(spark: SparkSession, sf_dir: str) -> str:
    """A pane table made in two updates, cut inside a pane."""
    rows, folder = obs(spark, sf_dir), shared_folder(spark, "pane_table")
    at = F.col("ms") < ANCHOR + 301 * HOUR
    for name, part in (("first", rows.where(at)), ("second", rows.where(~at))):
        PT.add_panes(part, folder, name, PANE)
    return folder


@query(f"WITH {PANES} SELECT stream, start_ms, end_ms, count, round(sum, 8) AS sum, min, max FROM panes")
def pane_table_in_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a table built in two steps are those of one built at once."""
    return rounded(PT.read_panes(spark, _grown(spark, sf_dir)), "sum")


@query(f"WITH {REC} SELECT stream, win_start, win_end, count, round(avg, 8) AS avg FROM rec WHERE win_start >= {ANCHOR + 240 * HOUR} AND win_end <= {ANCHOR + 360 * HOUR}")
def windows_from_pane_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five days from the kept table, of which only those days are read."""
    lo, hi = ANCHOR + 240 * HOUR, ANCHOR + 360 * HOUR
    rows = P.recompose(PT.read_panes(spark, _grown(spark, sf_dir), lo_ms=lo, hi_ms=hi), SPEC, PANE)
    return rounded(rows.where((F.col("win_start") >= lo) & (F.col("win_end") <= hi)), "avg").select("stream", "win_start", "win_end", "count", "avg")


CONSUMERS = "consumers AS (SELECT c_custkey AS consumer_id, CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END AS canonical_id FROM customer)"


def consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("consumer_id"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("canonical_id"))


@query(f"WITH {PANES}, {CONSUMERS}, d AS (SELECT stream AS canonical_id, start_ms // {24 * HOUR} AS day, round(sum(sum) / sum(count), 8) AS avg FROM panes GROUP BY ALL) SELECT consumer_id, canonical_id, day, avg FROM consumers JOIN d USING (canonical_id)")
def shared_result_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = states(spark, sf_dir).withColumn("day", F.floor(F.col("start_ms") / (24 * HOUR)))
    result = rounded(P.recompose_flat(days, ["stream", "day"]), "avg").select(F.col("stream").alias("canonical_id"), "day", "avg")
    result = PT.share(result, shared_folder(spark, "shared_result"))  # once, for all consumers
    return P.shared_result(consumers(spark, sf_dir), result).select("consumer_id", "canonical_id", "day", "avg")


@query(f"WITH {REC} SELECT win_start, win_end, stream, CAST(sum(count) OVER o AS BIGINT) AS count_to, round(sum(sum) OVER o, 8) AS sum_to, round(sum(sum) OVER o / sum(count) OVER o, 8) AS avg_to FROM rec WINDOW o AS (PARTITION BY win_start, win_end ORDER BY stream)")
def nested_target_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.nested_targets(P.recompose(states(spark, sf_dir), SPEC, PANE), "stream")
    return rounded(rows, "sum_to", "avg_to").select("win_start", "win_end", "stream", "count_to", "sum_to", "avg_to")


@query(f"WITH {REC} SELECT stream, win_start, round(avg, 8) AS exact, round(avg, 8) AS recomposed, 0.0::DOUBLE AS error FROM rec")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's average from panes beside the one from raw rows, and the difference."""
    exact = rounded(W.window_agg(obs(spark, sf_dir), SPEC, ["avg"]), "avg").select("stream", "win_start", F.col("avg").alias("exact"))
    made = rounded(P.recompose(states(spark, sf_dir), SPEC, PANE), "avg").select("stream", "win_start", F.col("avg").alias("recomposed"))
    return exact.join(made, ["stream", "win_start"], "full").withColumn("error", F.abs(F.col("exact") - F.col("recomposed")))
