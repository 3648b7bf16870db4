"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.matchers import Matcher
from .model import PREFIX, Grid, column, day_of, label, slot
from .operators.select import Storage
from .plans.compiler import Query, compile_query
from .sources import store, tables

Builder = Callable[[SparkSession, str], DataFrame]

START, END, DAY, HOUR = 1_704_067_200_000, 1_706_659_200_000, 86_400_000, 3_600_000  # 2024-01-01 to 2024-01-31
DAILY = Grid(START, END, DAY)
LOOKBACK = 6 * HOUR


def shown(df: DataFrame, labels: list[str], digits: int = 8) -> DataFrame:
    """Labels under their own names, values rounded."""
    return df.select("step", F.round("value", digits).alias("value"), *(label(x).alias(x.strip("_")) for x in labels))


def query(text: str, source: Callable[[SparkSession, str], DataFrame] = tables.events, grid: Grid = DAILY, lookback: int = LOOKBACK) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = compile_query(Storage(source(spark, sf_dir), lookback_ms=lookback, every=source in tables.EVERY), text, grid)
        return shown(q.df, q.labels)

    return run


# SQL parts: samples, evaluation times, instant vectors
_EV = "ev AS (SELECT epoch_us(ts) // 1000 AS ts_ms, event_type, CAST(user_id AS VARCHAR) AS user_id, value FROM events)"
_G = f"g AS (SELECT UNNEST(generate_series({START}, {END}, {DAY})) AS step)"
_IV = f"iv AS (SELECT step, event_type, user_id, arg_max(value, ts_ms) AS v FROM ev JOIN g ON ts_ms > step - {LOOKBACK} AND ts_ms <= step GROUP BY ALL)"
_BT = f"bt AS (SELECT step, event_type, arg_max(value, ts_ms) AS v, max(ts_ms) AS t FROM ev JOIN g ON ts_ms > step - {LOOKBACK} AND ts_ms <= step GROUP BY ALL)"
_W = f"WITH {_EV}, {_G}, {_IV}, {_BT} "
_DAYWIN = f"FROM ev JOIN g ON ts_ms > step - {DAY} AND ts_ms <= step GROUP BY step, event_type"
_PREV = "p AS (SELECT ts_ms, event_type, value, lag(value) OVER w AS pv, lag(ts_ms) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts_ms))"


def _agg(f: str, by: str = "event_type") -> str:
    keys = f", {by}" if by else ""
    return f"{_W} SELECT step, round({f}, 8) AS value{keys} FROM iv GROUP BY step{keys}"


def _over(f: str, having: str = "") -> str:
    return f"{_W} SELECT step, round({f}, 8) AS value, event_type {_DAYWIN} {having}"


def _range(kind: str) -> str:
    """rate, increase, delta: extrapolated change over one day."""
    counter = kind != "delta"
    zero = "CASE WHEN change > 0 AND v0 >= 0 AND sampled * v0 / change < d0 THEN sampled * v0 / change ELSE d0 END" if counter else "d0"
    resets = "+ resets - first_reset" if counter else ""
    value = f"change * ((sampled + {zero} + d1) / sampled)" + (f" / {DAY / 1000}" if kind == "rate" else "")
    return f"""{_W}, {_PREV}, r AS (SELECT *, CASE WHEN value < pv THEN pv ELSE 0 END AS reset FROM p),
    a AS (SELECT step, event_type, count(*) AS n, arg_min(value, ts_ms) AS v0, arg_max(value, ts_ms) AS v1, min(ts_ms) AS t0, max(ts_ms) AS t1, sum(reset) AS resets, arg_min(reset, ts_ms) AS first_reset
      FROM r JOIN g ON ts_ms > step - {DAY} AND ts_ms <= step GROUP BY ALL HAVING count(*) > 1),
    b AS (SELECT *, v1 - v0 {resets} AS change, (t1 - t0) / 1000.0 AS sampled, (t1 - t0) / 1000.0 / (n - 1) AS gap, (t0 - step + {DAY}) / 1000.0 AS e0, (step - t1) / 1000.0 AS e1 FROM a),
    c AS (SELECT *, CASE WHEN e0 >= gap * 1.1 THEN gap / 2 ELSE e0 END AS d0, CASE WHEN e1 >= gap * 1.1 THEN gap / 2 ELSE e1 END AS d1 FROM b)
    SELECT step, round({value}, 8) AS value, event_type FROM c"""


_by_type = tables.events_by_type


def _shown(q: Query) -> DataFrame:
    return shown(q.df, q.labels)


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_value_bucket{event_type, user_id, le}: 1 in every bucket that holds the sample, 0 in the others."""
    rows = tables.events(spark, sf_dir).withColumn(column("__name__"), F.lit("event_value_bucket"))
    rows = rows.withColumn(column("le"), F.explode(F.array(*(F.lit(x) for x in ("10", "50", "100", "+Inf")))))
    bound = F.when(label("le") == "+Inf", float("inf")).otherwise(label("le").try_cast("double"))
    return rows.withColumn("value", (F.col("value") <= bound).cast("double"))


def _native(samples: str, quantity: str) -> str:
    """Numbers of the sum of one-observation histograms: `samples` has step, event_type and v; buckets are (2^((i-1)/2), 2^(i/2)]."""
    return f"""{_W}, m AS ({samples}), k AS (SELECT step, event_type, CASE WHEN v <= 1 THEN 0 ELSE CAST(ceil(round(log2(v) * 2, 9)) AS INT) END AS i, v <= 1 AS z, v FROM m),
    b AS (SELECT step, event_type, i, z, CAST(count(*) AS DOUBLE) AS c, sum(v) AS s FROM k GROUP BY ALL),
    t AS (SELECT *, sum(c) OVER w AS n, sum(s) OVER w AS total, count(*) FILTER (NOT z) OVER w AS filled, sum(c) OVER (PARTITION BY step, event_type ORDER BY z DESC, i) AS upto FROM b WINDOW w AS (PARTITION BY step, event_type)),
    r AS (SELECT *, CASE WHEN z THEN CASE WHEN filled > 0 THEN 0.0 ELSE -1.0 END ELSE (i - 1) / 2.0 END AS low, CASE WHEN z THEN 1.0 ELSE i / 2.0 END AS high FROM t)
    {quantity}"""


_INSTANT_HISTOGRAMS = "SELECT step, event_type, v FROM iv"
_DAY_HISTOGRAMS = f"SELECT step, event_type, value AS v FROM ev JOIN g ON ts_ms > step - {DAY} AND ts_ms <= step"
# counted from above, so a rank that ends a bucket takes the one with the larger numbers
_NATIVE_QUANTILE = """SELECT step, round(CASE WHEN z THEN low + (high - low) * share ELSE 2 ** (low + (high - low) * share) END, 8) AS value, event_type
    FROM (SELECT *, 1 - ((1 - 0.9) * n - (n - upto)) / c AS share FROM r QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY upto - c DESC) = 1 + count(*) FILTER (n - upto + c < (1 - 0.9) * n) OVER (PARTITION BY step, event_type))"""

QUERIES: dict[str, tuple[Builder, str]] = {
    "native_histogram_quantile": (query("histogram_quantile(0.9, sum by (event_type) (event_sizes))", tables.event_histograms), _native(_INSTANT_HISTOGRAMS, _NATIVE_QUANTILE)),
    "native_histogram_over_time": (query("histogram_quantile(0.9, sum by (event_type) (sum_over_time(event_sizes_by_type[1d])))", tables.event_histograms_by_type), _native(_DAY_HISTOGRAMS, _NATIVE_QUANTILE)),
    "native_histogram_numbers": (query("histogram_avg(sum by (event_type) (event_sizes)) + histogram_count(2 * sum by (event_type) (event_sizes)) + histogram_sum(avg by (event_type) (event_sizes))", tables.event_histograms), _native(_INSTANT_HISTOGRAMS, "SELECT DISTINCT step, round(2 * total / n + 2 * n, 8) AS value, event_type FROM (SELECT step, event_type, max(total) AS total, max(n) AS n FROM r GROUP BY ALL)")),
    "native_histogram_fraction": (query("histogram_fraction(0.5, 16, sum by (event_type) (event_sizes))", tables.event_histograms), _native(_INSTANT_HISTOGRAMS, "SELECT step, round(sum(CASE WHEN z THEN c * (1 - greatest(0.5 - low, 0) / (high - low)) WHEN high <= 4 THEN c ELSE 0 END) / max(n), 8) AS value, event_type FROM r GROUP BY step, event_type")),
    "native_histogram_count": (query("count by (event_type) (event_sizes)", tables.event_histograms), _agg("CAST(count(*) AS DOUBLE)")),
    "instant_selector": (query("event_value"), f"{_W} SELECT step, round(v, 8) AS value, 'event_value' AS name, event_type, user_id FROM iv"),
    "agg_sum_by": (query("sum by (event_type) (event_value)"), _agg("sum(v)")),
    "agg_avg_by": (query("avg by (event_type) (event_value)"), _agg("avg(v)")),
    "agg_count_without": (query("count without (user_id) (event_value)"), _agg("CAST(count(*) AS DOUBLE)")),
    "agg_min_max": (query("max by (event_type) (event_value) - min by (event_type) (event_value)"), _agg("max(v) - min(v)")),
    "agg_stddev": (query("stddev by (event_type) (event_value)"), _agg("stddev_pop(v)")),
    "agg_stdvar": (query("stdvar by (event_type) (event_value)"), _agg("var_pop(v)")),
    "agg_quantile": (query("quantile by (event_type) (0.8, event_value)"), _agg("quantile_cont(v, 0.8)")),
    "agg_group": (query("group by (event_type) (event_value)"), _agg("1.0::DOUBLE")),
    "agg_sum_all": (query("sum(event_value)"), _agg("sum(v)", "")),
    "agg_nested": (query("max(sum by (event_type) (event_value))"), f"{_W} SELECT step, round(max(s), 8) AS value FROM (SELECT step, event_type, sum(v) AS s FROM iv GROUP BY ALL) GROUP BY step"),
    "agg_topk": (query("topk by (event_type) (2, event_value)"), f"{_W} SELECT step, round(v, 8) AS value, 'event_value' AS name, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY step, event_type ORDER BY v DESC, event_type, user_id) AS n FROM iv) WHERE n <= 2"),
    "agg_bottomk": (query("bottomk(3, event_value)"), f"{_W} SELECT step, round(v, 8) AS value, 'event_value' AS name, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY v, event_type, user_id) AS n FROM iv) WHERE n <= 3"),
    "agg_count_values": (query('count_values by (event_type) ("v", floor(event_value / 10))'), f"{_W} SELECT step, CAST(count(*) AS DOUBLE) AS value, event_type, CAST(CAST(floor(v / 10) AS BIGINT) AS VARCHAR) AS v FROM iv GROUP BY step, event_type, 4"),
    "match_equal": (query('count(event_value{event_type="click"})'), f"{_W} SELECT step, CAST(count(*) AS DOUBLE) AS value FROM iv WHERE event_type = 'click' GROUP BY step"),
    "match_not_equal": (query('sum by (event_type) (event_value{event_type!="click"})'), _agg("sum(v)").replace("FROM iv", "FROM iv WHERE event_type <> 'click'")),
    "match_regex": (query('sum by (event_type) (event_value{event_type=~"c.*|v.+w"})'), _agg("sum(v)").replace("FROM iv", "FROM iv WHERE regexp_full_match(event_type, 'c.*|v.+w')")),
    "match_regex_set": (query('sum by (event_type) (event_value{event_type=~"click|view"})'), _agg("sum(v)").replace("FROM iv", "FROM iv WHERE event_type IN ('click', 'view')")),
    "match_not_regex": (query('sum by (event_type) (event_value{user_id!~"1.*"})'), _agg("sum(v)").replace("FROM iv", "FROM iv WHERE NOT regexp_full_match(user_id, '1.*')")),
    "match_absent_label": (query('count(event_value{nope="", event_type!=""})'), _agg("CAST(count(*) AS DOUBLE)", "")),
    "over_time_sum": (query("sum_over_time(event_value_by_type[1d])", _by_type), _over("sum(value)")),
    "over_time_avg": (query("avg_over_time(event_value_by_type[1d])", _by_type), _over("avg(value)")),
    "over_time_min_max": (query("max_over_time(event_value_by_type[1d]) - min_over_time(event_value_by_type[1d])", _by_type), _over("max(value) - min(value)")),
    "over_time_count": (query("count_over_time(event_value_by_type[1d])", _by_type), _over("CAST(count(*) AS DOUBLE)")),
    "over_time_stddev": (query("stddev_over_time(event_value_by_type[1d])", _by_type), _over("stddev_pop(value)")),
    "over_time_quantile": (query("quantile_over_time(0.9, event_value_by_type[1d])", _by_type), _over("quantile_cont(value, 0.9)")),
    "over_time_last": (query("last_over_time(event_value_by_type[1d])", _by_type), f"{_W} SELECT step, round(arg_max(value, ts_ms), 8) AS value, 'event_value_by_type' AS name, event_type {_DAYWIN}"),
    "range_rate": (query("rate(event_value_by_type[1d])", _by_type), _range("rate")),
    "range_increase": (query("increase(event_value_by_type[1d])", _by_type), _range("increase")),
    "range_delta": (query("delta(event_value_by_type[1d])", _by_type), _range("delta")),
    "range_irate": (query("irate(event_value_by_type[1d])", _by_type), f"{_W}, {_PREV} SELECT step, round(CASE WHEN v < pv THEN v ELSE v - pv END / ((t - pt) / 1000.0), 8) AS value, event_type FROM (SELECT step, event_type, arg_max(value, ts_ms) AS v, max(ts_ms) AS t, arg_max(pv, ts_ms) AS pv, arg_max(pt, ts_ms) AS pt FROM p JOIN g ON ts_ms > step - {DAY} AND ts_ms <= step GROUP BY ALL) WHERE pt > step - {DAY}"),
    "range_changes_resets": (query("changes(event_value_by_type[1d]) + resets(event_value_by_type[1d])", _by_type), f"{_W}, {_PREV}, c AS (SELECT *, CASE WHEN value <> pv THEN 1 ELSE 0 END + CASE WHEN value < pv THEN 1 ELSE 0 END AS k FROM p) SELECT step, CAST(sum(k) - arg_min(k, ts_ms) AS DOUBLE) AS value, event_type FROM c JOIN g ON ts_ms > step - {DAY} AND ts_ms <= step GROUP BY step, event_type"),
    "range_deriv": (query("deriv(event_value_by_type[1d])", _by_type), f"{_W} SELECT step, round(regr_slope(value, (ts_ms - step) / 1000.0), 8) AS value, event_type {_DAYWIN} HAVING count(*) > 1"),
    "offset": (query("sum by (event_type) (event_value offset 1d)"), f"WITH {_EV}, {_G}, iv AS (SELECT step, event_type, user_id, arg_max(value, ts_ms) AS v FROM ev JOIN g ON ts_ms > step - {DAY} - {LOOKBACK} AND ts_ms <= step - {DAY} GROUP BY ALL) SELECT step, round(sum(v), 8) AS value, event_type FROM iv GROUP BY step, event_type"),
    "pinned_at": (query(f"sum by (event_type) (event_value @ {(START + 10 * DAY) // 1000})"), f"{_W} SELECT g.step, value, event_type FROM (SELECT round(sum(v), 8) AS value, event_type FROM iv WHERE step = {START + 10 * DAY} GROUP BY event_type), g"),
    "subquery": (query("max_over_time(sum(event_value_by_type)[1d:6h])", _by_type), f"""WITH {_EV}, {_G}, s AS (SELECT UNNEST(generate_series({START - DAY}, {END}, {6 * HOUR})) AS t), i AS (SELECT t, event_type, arg_max(value, ts_ms) AS v FROM ev JOIN s ON ts_ms > t - {LOOKBACK} AND ts_ms <= t GROUP BY ALL), x AS (SELECT t, sum(v) AS v FROM i GROUP BY t)
        SELECT step, round(max(v), 8) AS value FROM x JOIN g ON t > step - {DAY} AND t <= step GROUP BY step"""),
    "arithmetic": (query("(sum by (event_type) (event_value) * 2 - 1) / 3 % 7 + 2 ^ 3"), _agg("(sum(v) * 2 - 1) / 3 % 7 + 8")),
    "comparison_filter": (query("sum by (event_type) (event_value) > 50"), f"SELECT * FROM ({_agg('sum(v)')}) WHERE value > 50"),
    "comparison_bool": (query("sum by (event_type) (event_value) > bool 50"), _agg("CAST(CAST(sum(v) > 50 AS INT) AS DOUBLE)")),
    "join_one_to_one": (query("sum by (event_type) (event_value) / count by (event_type) (event_value)"), _agg("sum(v) / count(*)")),
    "join_group_left": (query("event_value / on (event_type) group_left () sum by (event_type) (event_value)"), f"{_W} SELECT step, round(v / sum(v) OVER (PARTITION BY step, event_type), 8) AS value, event_type, user_id FROM iv"),
    "join_ignoring": (query("event_value - ignoring (user_id) group_left avg without (user_id) (event_value)"), f"{_W} SELECT step, round(v - avg(v) OVER (PARTITION BY step, event_type), 8) AS value, event_type, user_id FROM iv"),
    "join_group_right": (query("sum by (event_type) (event_value) - on (event_type) group_right () event_value"), f"{_W} SELECT step, round(sum(v) OVER (PARTITION BY step, event_type) - v, 8) AS value, event_type, user_id FROM iv"),
    "set_and": (query('event_value and on (user_id) event_value{event_type="click"}'), f"{_W} SELECT step, round(v, 8) AS value, 'event_value' AS name, event_type, user_id FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE b.step = a.step AND b.user_id = a.user_id AND b.event_type = 'click')"),
    "set_unless": (query('event_value unless on (user_id) event_value{event_type="click"}'), f"{_W} SELECT step, round(v, 8) AS value, 'event_value' AS name, event_type, user_id FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE b.step = a.step AND b.user_id = a.user_id AND b.event_type = 'click')"),
    "set_or": (query('event_value{event_type="click"} or on (user_id) event_value{event_type="view"}'), f"{_W} SELECT step, round(v, 8) AS value, 'event_value' AS name, event_type, user_id FROM iv a WHERE event_type = 'click' OR event_type = 'view' AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.step = a.step AND b.user_id = a.user_id AND b.event_type = 'click')"),
    "absent": (query('absent(event_value{event_type="click", user_id="1"})'), f"{_W} SELECT step, 1.0::DOUBLE AS value, 'click' AS event_type, '1' AS user_id FROM g WHERE step NOT IN (SELECT step FROM iv WHERE event_type = 'click' AND user_id = '1')"),
    "functions_math": (query("sqrt(abs(ln(sum by (event_type) (event_value)))) + ceil(sum by (event_type) (event_value) / 7)"), _agg("sqrt(abs(ln(sum(v)))) + ceil(sum(v) / 7)")),
    "functions_round_clamp": (query("clamp(round(sum by (event_type) (event_value), 5), 20, 100)"), _agg("greatest(20, least(100, floor(sum(v) * (1.0 / 5) + 0.5) / (1.0 / 5)))")),
    "functions_time": (query("timestamp(event_value_by_type) - time()", _by_type), f"{_W} SELECT step, round(t / 1000.0 - step / 1000.0, 8) AS value, event_type FROM bt"),
    "functions_calendar": (query("day_of_month() * 100 + month() + hour() + day_of_week()"), f"WITH {_G} SELECT step, CAST(extract(day FROM d) * 100 + extract(month FROM d) + extract(hour FROM d) + extract(dow FROM d) AS DOUBLE) AS value FROM (SELECT step, make_timestamp(step * 1000) AS d FROM g)"),
    "functions_scalar_vector": (query("scalar(sum(event_value)) + vector(1)"), f"{_W} SELECT g.step, round(coalesce(s, 'NaN'::DOUBLE) + 1, 8) AS value FROM g LEFT JOIN (SELECT step, sum(v) AS s FROM iv GROUP BY step) x ON x.step = g.step"),
    "match_regex_flags": (query('sum by (event_type) (event_value{event_type=~"(?i)CLICK|V[[:alpha:]]+"})'), _agg("sum(v)").replace("FROM iv", "FROM iv WHERE regexp_full_match(event_type, 'click|v[a-z]+')")),
    "match_external": (lambda spark, sf_dir: _shown(compile_query(Storage(tables.events(spark, sf_dir), external={"region": "eu"}, lookback_ms=LOOKBACK), 'sum by (region, event_type) (event_value{region=~"e.", event_type!="click"})', DAILY)), f"{_W} SELECT step, round(sum(v), 8) AS value, event_type, 'eu' AS region FROM iv WHERE event_type <> 'click' GROUP BY step, event_type"),
    "over_time_present_stdvar": (query("present_over_time(event_value_by_type[1d]) + stdvar_over_time(event_value_by_type[1d])", _by_type), _over("1 + var_pop(value)")),
    "over_time_absent": (query('absent_over_time(event_value{event_type="click", user_id="1"}[1d])'), f"{_W} SELECT step, 1.0::DOUBLE AS value, 'click' AS event_type, '1' AS user_id FROM g WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ts_ms > step - {DAY} AND ts_ms <= step AND event_type = 'click' AND user_id = '1')"),
    "over_time_short_step": (query("sum_over_time(event_value_by_type[6h])", _by_type, Grid(START, START + 3 * DAY, HOUR // 4)), f"{_W}, q AS (SELECT UNNEST(generate_series({START}, {START + 3 * DAY}, {HOUR // 4})) AS step) SELECT step, round(sum(value), 8) AS value, event_type FROM ev JOIN q ON ts_ms > step - {6 * HOUR} AND ts_ms <= step GROUP BY step, event_type"),
    "range_idelta": (query("idelta(event_value_by_type[1d])", _by_type), f"{_W}, {_PREV} SELECT step, round(v - pv, 8) AS value, event_type FROM (SELECT step, event_type, arg_max(value, ts_ms) AS v, arg_max(pv, ts_ms) AS pv, arg_max(pt, ts_ms) AS pt FROM p JOIN g ON ts_ms > step - {DAY} AND ts_ms <= step GROUP BY step, event_type) WHERE pt > step - {DAY}"),
    "range_predict_linear": (query("predict_linear(event_value_by_type[1d], 3600)", _by_type), f"{_W} SELECT step, round(regr_intercept(value, (ts_ms - step) / 1000.0) + 3600 * regr_slope(value, (ts_ms - step) / 1000.0), 8) AS value, event_type {_DAYWIN} HAVING count(*) > 1"),
    "functions_trigonometry": (query("sin(sum by (event_type) (event_value)) + atan(count by (event_type) (event_value)) * pi()"), _agg("sin(sum(v)) + atan(count(*)) * pi()")),
    "histogram_quantile": (lambda spark, sf_dir: _shown(compile_query(Storage(_buckets(spark, sf_dir), lookback_ms=LOOKBACK), "histogram_quantile(0.9, sum by (event_type, le) (event_value_bucket))", DAILY)), f"""{_W}, b AS (SELECT step, event_type, bound, count(*) FILTER (v <= bound) AS c FROM iv, (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), ('Infinity'::DOUBLE)) x(bound) GROUP BY ALL),
        r AS (SELECT *, lag(c) OVER w AS pc, lag(bound) OVER w AS pb, max(c) OVER (PARTITION BY step, event_type) AS total FROM b WINDOW w AS (PARTITION BY step, event_type ORDER BY bound))
        SELECT step, round(arg_min(CASE WHEN isinf(bound) THEN pb ELSE coalesce(pb, 0) + (bound - coalesce(pb, 0)) * (0.9 * total - coalesce(pc, 0)) / nullif(c - coalesce(pc, 0), 0) END, bound), 8) AS value, event_type FROM r WHERE c >= 0.9 * total GROUP BY step, event_type"""),
    "join_on": (query("sum by (event_type) (event_value) / on (event_type) count by (event_type) (event_value)"), _agg("sum(v) / count(*)")),
    "join_ignoring_one_to_one": (query('sum without (user_id) (event_value{event_type="click"}) - ignoring (event_type) sum without (user_id) (event_value{event_type="view"})'), f"{_W}, s AS (SELECT step, event_type, sum(v) AS x FROM iv GROUP BY ALL) SELECT a.step, round(a.x - b.x, 8) AS value FROM s a JOIN s b ON a.step = b.step AND a.event_type = 'click' AND b.event_type = 'view'"),
    "join_empty_key": (query("event_value_by_type - on () group_left () sum(event_value_by_type)", _by_type), f"{_W} SELECT step, round(v - sum(v) OVER (PARTITION BY step), 8) AS value, event_type FROM bt"),
    "label_replace_named": (query('label_replace(sum by (event_type) (event_value), "kind", "${head}-x", "event_type", "(?P<head>..).*")'), f"{_W} SELECT step, round(sum(v), 8) AS value, event_type, substr(event_type, 1, 2) || '-x' AS kind FROM iv GROUP BY step, event_type"),
    "label_replace": (query('label_replace(sum by (event_type) (event_value), "kind", "$1-x", "event_type", "(..).*")'), f"{_W} SELECT step, round(sum(v), 8) AS value, event_type, substr(event_type, 1, 2) || '-x' AS kind FROM iv GROUP BY step, event_type"),
    "label_join": (query('label_join(sum by (event_type) (event_value), "both", "/", "event_type", "event_type")'), f"{_W} SELECT step, round(sum(v), 8) AS value, event_type, event_type || '/' || event_type AS both FROM iv GROUP BY step, event_type"),
}


def _meta(build: Callable[[Storage], DataFrame], source: Callable[[SparkSession, str], DataFrame] = tables.events, **more) -> Builder:
    return lambda spark, sf_dir: build(Storage(source(spark, sf_dir), **more))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(c.removeprefix(PREFIX).strip("_")) for c in df.columns if c != "is_stale"))


_NAME = Matcher("event_type", "=", "click")


def _store(spark: SparkSession) -> store.Store:
    """A new store in the folder that the cluster shares."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = folder or f"file://{tempfile.mkdtemp(prefix='seriesforge-')}"
    return store.Store(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convert events to day blocks of a stream, open them again and query them."""
    s, external = _store(spark), {"region": "eu"}
    s.convert(tables.events(spark, sf_dir), external, ["events"])
    opened = s.open(store.stream_hash(spark, external), START - LOOKBACK, END, lookback_ms=LOOKBACK)
    q = compile_query(opened, "sum by (region, event_type) (event_value)", DAILY)
    return shown(q.df, q.labels)


def late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two batches, the second one again, by event id: late days are merged, not replaced or doubled."""
    s, rows = _store(spark), tables.events(spark, sf_dir)
    for part in (0, 1, 1):
        s.convert(rows.where(F.pmod("event_id", F.lit(2)) == part), {}, [f"part-{part}"])
    opened = s.open(0, START - LOOKBACK, END, lookback_ms=LOOKBACK)
    return _shown(compile_query(opened, "sum by (event_type) (event_value)", DAILY))


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a stream, from the stored series alone."""
    s = _store(spark)
    s.convert(tables.events(spark, sf_dir), {"region": "eu"}, ["events"])
    return _plain(s.open(store.stream_hash(spark, {"region": "eu"}), 0, 1 << 45).series([_NAME]))


def stored_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and external labels of the streams of a store."""
    s = _store(spark)
    s.convert(tables.events(spark, sf_dir), {"region": "eu"}, ["events"])
    return s.info().select("external_labels", "mint", "maxt")


def planned_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are planned for conversion if the blocks of raw samples are the weeks of events and one day is done."""
    days = tables.events(spark, sf_dir).agg(F.min("ts_ms"), F.max("ts_ms")).first()
    first, last = days[0] // (7 * DAY), days[1] // (7 * DAY)
    sources = [store.Source(str(k), k * 7 * DAY, (k + 1) * 7 * DAY) for k in range(first, last + 1)]
    rows = store.plan(sources, [day_of(START)], day_of(END))
    return spark.createDataFrame([(d, len(need)) for d, need in rows], "day date, sources bigint")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What discovery sees after a conversion: day, series, samples, mint, maxt."""
    s = _store(spark)
    s.convert(tables.events(spark, sf_dir), {}, ["events"])
    return s.discover().select("day", "series", "samples", "mint", "maxt")


QUERIES |= {
    "store_query": (stored, f"{_W} SELECT step, round(sum(v), 8) AS value, event_type, 'eu' AS region FROM iv GROUP BY step, event_type"),
    "store_blocks": (blocks, "SELECT CAST(ts AS DATE) AS day, count(DISTINCT (event_type, user_id)) AS series, count(DISTINCT (event_type, user_id, epoch_us(ts) // 1000)) AS samples, min(epoch_us(ts) // 1000) AS mint, max(epoch_us(ts) // 1000) AS maxt FROM events GROUP BY 1"),
    "store_late_batch": (late_batch, _agg("sum(v)")),
    "store_metadata": (stored_metadata, "SELECT DISTINCT 'event_value' AS name, event_type, CAST(user_id AS VARCHAR) AS user_id, 'eu' AS region FROM events WHERE event_type = 'click'"),
    "store_info": (stored_info, """SELECT '{"region": "eu"}' AS external_labels, min(epoch_us(ts) // 1000) AS mint, max(epoch_us(ts) // 1000) AS maxt FROM events"""),
    "store_plan": (planned_days, f"""WITH w AS (SELECT min(epoch_us(ts) // 1000) // {7 * DAY} AS a, max(epoch_us(ts) // 1000) // {7 * DAY} AS b FROM events)
        SELECT CAST(make_timestamp(d * {DAY} * 1000) AS DATE) AS day, CAST(1 AS BIGINT) AS sources FROM (SELECT UNNEST(generate_series(a * 7, b * 7 + 6)) AS d FROM w) WHERE d * {DAY} < {END} AND d * {DAY} <> {START}"""),
    "label_names_matched": (_meta(lambda s: s.label_names([Matcher("event_type", "=~", "c.+")])), "SELECT UNNEST(['__name__', 'event_type', 'user_id']) AS name"),
    "label_names": (_meta(lambda s: s.label_names()), "SELECT UNNEST(['__name__', 'event_type', 'user_id']) AS name"),
    "label_values": (_meta(lambda s: s.label_values("event_type")), "SELECT DISTINCT event_type AS value FROM events"),
    "label_values_matched": (_meta(lambda s: s.label_values("user_id", [_NAME])), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'"),
    "label_values_external": (_meta(lambda s: s.label_values("region"), external={"region": "eu"}), "SELECT 'eu' AS value"),
    "series": (_meta(lambda s: _plain(s.series([_NAME]))), "SELECT DISTINCT 'event_value' AS name, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'click'"),
    "series_limit": (_meta(lambda s: _plain(s.series([_NAME], limit=5))), "SELECT DISTINCT 'event_value' AS name, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'click' ORDER BY user_id LIMIT 5"),
    "select_external_replica": (_meta(lambda s: _plain(s.select([_NAME])), external={"region": "eu"}, replica=("user_id",)), "SELECT ts_ms, value, 'event_value' AS name, event_type, 'eu' AS region FROM (SELECT epoch_us(ts) // 1000 AS ts_ms, event_type, arg_min(value, (CAST(user_id AS VARCHAR), event_id)) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)"),
    # the merged sample is the first by the source's order columns, by name
    "select_merged_samples": (_meta(lambda s: _plain(s.select([])), tables.lineitems), "SELECT ts_ms, value, name, returnflag, linestatus FROM (SELECT epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS value, 'lineitem_quantity' AS name, l_returnflag AS returnflag, l_linestatus AS linestatus, row_number() OVER (PARTITION BY l_shipdate, l_returnflag, l_linestatus ORDER BY l_linenumber, l_orderkey, l_quantity) AS n FROM lineitem) WHERE n = 1"),
    "chunk_slots": (lambda spark, sf_dir: tables.events(spark, sf_dir).groupBy(slot(F.col("ts_ms")).alias("slot")).agg(F.count("*").alias("n")), "SELECT CAST((epoch_us(ts) // 1000 // 28800000) % 3 AS INT) AS slot, count(*) AS n FROM events GROUP BY 1"),
    "series_per_day": (lambda spark, sf_dir: store.days_of_streams(tables.events(spark, sf_dir)), "SELECT CAST(ts AS DATE) AS day, count(DISTINCT (event_type, user_id)) AS series, count(*) AS samples FROM events GROUP BY 1"),
}
