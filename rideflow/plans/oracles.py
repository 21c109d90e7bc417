"""The catalogue's queries in plain SQL, written from the definitions.

Snapshots, for one, join every snapshot to the rides of its prefix here, where the DataFrame plan
places each ride once.
"""

from __future__ import annotations

from rideflow.functions.hexagons import CENTRE_LAT, CENTRE_LNG, EAST_M, NORTH_M, RADIUS_M
from rideflow.plans.catalog import FORECAST_FROM, CURRENT_AFTER, DAY, PAST_AFTER, PAST_BEFORE, SERVED_DAYS

_RIDES = """
parts AS (
  SELECT event_id, event_type, user_id, ts, cast(floor(value * 60) AS bigint) AS seconds,
         cast(json_extract_string(props, '$.k') AS int) AS k
  FROM events
),
stations AS (
  SELECT *,
         CASE WHEN k % 10 = 0 THEN NULL ELSE concat('S', user_id % 20) END AS start_station_id,
         CASE WHEN k % 7 = 0 THEN NULL ELSE concat('S', k % 20) END AS end_station_id
  FROM parts
),
rides AS (
  SELECT cast(event_id AS varchar) AS ride_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'classic_bike'
              WHEN event_type IN ('view', 'signup') THEN 'electric_bike'
              ELSE 'docked_bike' END AS rideable_type,
         ts AS started_at,
         ts + to_seconds(seconds) AS ended_at,
         'Station ' || substr(start_station_id, 2) AS start_station_name,
         start_station_id,
         'Station ' || substr(end_station_id, 2) AS end_station_name,
         end_station_id,
         cast(38.888 + ((user_id % 20) - 10) * 0.005 AS double) AS start_lat,
         cast(-77.021 + ((k % 20) - 10) * 0.005 AS double) AS start_lng,
         cast(38.888 + ((k % 20) - 10) * 0.005 AS double) AS end_lat,
         cast(-77.021 + ((user_id % 20) - 10) * 0.005 AS double) AS end_lng,
         CASE WHEN user_id % 2 = 0 THEN 'member' ELSE 'casual' END AS member_casual
  FROM stations
)"""

_PRICED = (
    _RIDES
    + """,
timed AS (
  SELECT *, cast(epoch(date_trunc('second', ended_at)) - epoch(date_trunc('second', started_at))
                 AS double) AS duration_seconds,
         cast(started_at AS date) AS date
  FROM rides
),
fares AS (
  SELECT *, cast(CASE
    WHEN member_casual = 'casual' AND rideable_type = 'classic_bike'
      THEN 1200 + 60 * round_even(duration_seconds / 60.0::double, 0)
    WHEN member_casual = 'casual' AND rideable_type = 'electric_bike'
      THEN 1200 + 180 * round_even(duration_seconds / 60.0::double, 0)
    WHEN member_casual = 'member' AND rideable_type = 'classic_bike'
      THEN CASE WHEN duration_seconds > 45 * 60 THEN duration_seconds - 45 * 60
                WHEN duration_seconds IS NOT NULL THEN 0 END
    WHEN member_casual = 'member' AND rideable_type = 'electric_bike' THEN 2 * duration_seconds
    ELSE 0 END AS bigint) AS fare
  FROM timed
),
priced AS (
  SELECT *, fare::double / 1200.0::double AS revenue FROM fares
)"""
)

_WEATHER = """
weather AS (
  SELECT cast(cast(ts AS date) AS timestamp) AS datetime,
         cast(max(value) / 10 AS double) AS tempmax,
         cast(min(value) AS double) AS tempmin,
         cast(count(*) % 100 AS double) AS humidity,
         cast(max(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / 10 AS double) AS precip,
         cast(0 AS double) AS snow,
         cast(max(CASE WHEN event_type = 'view' THEN value ELSE 0 END) / 10
              AS double) AS windspeed,
         cast(max(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / 10
              AS double) AS windgust,
         CASE WHEN count(*) % 2 = 0 THEN 'Clear' ELSE 'Rain' END AS conditions
  FROM events GROUP BY cast(ts AS date)
)"""

_PAST = """
past_rides AS (
  SELECT cast(o_orderkey AS varchar) AS ride_id, o_orderdate AS started_at,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS start_station_id,
         nullif(o_orderstatus, 'P') AS end_station_id
  FROM orders
),
past_weather AS (
  SELECT cast(cast(l_shipdate AS date) AS timestamp) AS datetime,
         max(l_quantity) AS tempmax, min(l_quantity) AS tempmin,
         cast(sum(l_linenumber) % 100 AS double) AS humidity,
         max(l_tax) * 100 AS precip, min(l_tax) * 100 AS snow,
         max(l_discount) * 100 AS windspeed, max(l_extendedprice) / 1000 AS windgust,
         CASE WHEN max(l_quantity) > 45 THEN 'Clear' ELSE 'Rain' END AS conditions
  FROM lineitem GROUP BY cast(l_shipdate AS date)
)"""

_TRAINING = (
    _PAST
    + f""",
daily AS (
  SELECT cast(started_at AS date) AS date, count(*) AS count FROM past_rides
  WHERE started_at > timestamp '{PAST_AFTER}' AND started_at < timestamp '{PAST_BEFORE}'
    AND start_station_id IS NOT NULL AND end_station_id IS NOT NULL
  GROUP BY cast(started_at AS date)
),
training AS (
  SELECT d.*, w.* FROM daily d JOIN past_weather w ON cast(w.datetime AS date) = d.date
  WHERE w.datetime > timestamp '{PAST_AFTER}' AND w.datetime < timestamp '{PAST_BEFORE}'
)"""
)

# Every snapshot beside every ride of its prefix.
_SNAPSHOTS = (
    _PRICED
    + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY started_at, ride_id) - 1 AS rn
  FROM priced
),
days AS (
  SELECT date, count(*) AS n, greatest(1, count(*) // 8) AS step FROM priced GROUP BY date
),
snaps AS (
  SELECT date, n, step, cast(k AS int) AS k, k * step AS i
  FROM (SELECT *, unnest(range(0, (n - 1) // step + 1)) AS k FROM days)
),
prefixes AS (
  SELECT s.k, s.i, r.* FROM snaps s JOIN numbered r ON r.date = s.date AND r.rn <= s.i
)"""
)

_CLOCKS = """
clocks AS (
  SELECT s.date, s.k, s.i, r.started_at AS clock_at
  FROM snaps s JOIN numbered r ON r.date = s.date AND r.rn = greatest(s.i - 1, 0)
)"""


def _fixed(x: str, digits: int) -> str:
    scale = f"{10**digits}.0::double"
    return f"(round_even(({x}) * {scale}, 0)::double / {scale})"


def _steady(x: str) -> str:
    return _fixed(x, 6)


def _cents(units: str, rides: str = "1") -> str:
    """Units of 1/1200, for each of ``rides``, to two decimals."""
    ratio = f"cast({units} AS double) / nullif(12.0::double * {rides}, 0)"
    return f"(round_even({ratio}, 0)::double / 100.0::double)"


def _text(x: str) -> str:
    return f"regexp_replace(cast(cast({_fixed(x, 2)} AS decimal(18, 2)) AS varchar), '0$', '')"


def _dollars(x: str) -> str:
    return f"('$' || {_text(x)})"


_REVENUE = "(cast(coalesce(sum(fare), 0) AS double) / 1200.0::double)"
_PER_RIDE = "(cast(coalesce(sum(fare), 0) AS double) / (1200.0::double * count(*)))"
_COORDS = "start_lat, start_lng, end_lat, end_lng"
_FLOAT_COORDS = ", ".join(
    f"cast(cast({c} AS float) AS double) AS {c}"
    for c in ("start_lat", "start_lng", "end_lat", "end_lng")
)
_MEASURES = ("tempmax", "tempmin", "humidity", "precip", "snow", "windspeed", "windgust")
_FLOAT_WEATHER = ", ".join(f"cast(cast({c} AS float) AS double) AS {c}" for c in _MEASURES)
_CLEAN = """
clean AS (
  SELECT * EXCLUDE (date) FROM timed WHERE start_station_id IS NOT NULL
)"""
_CLEAN_TABLE = (
    f"WITH {_PRICED}, {_CLEAN} SELECT * EXCLUDE (duration_seconds), duration_seconds AS duration"
)


def _hexagons(rides: str, source: str, keys: str = "") -> str:
    """Count the rides of ``source`` per hexagon, and per ``keys`` if given."""
    return f"""WITH {rides},
flat AS (
  SELECT {keys} (start_lng - {CENTRE_LNG}::double) * {EAST_M!r}::double AS east,
         (start_lat - {CENTRE_LAT}::double) * {NORTH_M!r}::double AS north
  FROM {source}
),
axial AS (
  SELECT {keys}
         ({3**0.5 / 3!r}::double * east - {1 / 3!r}::double * north) / {RADIUS_M}::double AS q,
         ({2 / 3!r}::double * north) / {RADIUS_M}::double AS r
  FROM flat
),
cube AS (
  SELECT {keys} q, r, -q - r AS s, round_even(q, 0)::double AS rq, round_even(r, 0)::double AS rr,
         round_even(-q - r, 0)::double AS rs
  FROM axial
),
cells AS (
  SELECT {keys} CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s)
              THEN -rr - rs ELSE rq END AS q,
         CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) THEN rr
              WHEN abs(rr - r) > abs(rs - s) THEN -rq - rs ELSE rr END AS r
  FROM cube
)
SELECT {keys} cast(q AS bigint) AS q, cast(r AS bigint) AS r, count(*) AS rides
FROM cells GROUP BY ALL"""


def _top_station(end: str) -> str:
    station = f"{end}_station_name"
    return f"""WITH {_SNAPSHOTS},
counted AS (
  SELECT date, k, {station}, count(ride_id) AS rides FROM prefixes
  WHERE {station} IS NOT NULL GROUP BY ALL
)
SELECT date, k, {station}, rides FROM counted
QUALIFY row_number() OVER (PARTITION BY date, k ORDER BY rides DESC, {station}) = 1"""


def _kpis() -> str:
    def top(end: str) -> str:
        return f"""{end}_top AS (
  SELECT date, k, station, rides FROM (
    SELECT date, k, {end}_station_name AS station, count(ride_id) AS rides FROM prefixes
    WHERE {end}_station_name IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY date, k ORDER BY rides DESC, station) = 1
)"""

    def rpr(bike: str) -> str:
        shown = _cents(f"{bike}_fare", f"{bike}_rides")
        return f"CASE WHEN i + 1 > 1 THEN {shown} END AS {bike}_rpr"

    return f"""{_SNAPSHOTS}, {_CLOCKS}, {top("start")}, {top("end")},
bars AS (
  SELECT date, k, avg(rides) AS mean_bar FROM (
    SELECT date, k, date_trunc('hour', started_at) AS hour, rideable_type, count(*) AS rides
    FROM prefixes GROUP BY ALL)
  GROUP BY ALL
),
sums AS (
  SELECT date, k, coalesce(sum(fare), 0) AS fare,
         count(*) FILTER (rideable_type = 'classic_bike') AS classic_rides,
         count(*) FILTER (rideable_type = 'electric_bike') AS electric_rides,
         coalesce(sum(fare) FILTER (rideable_type = 'classic_bike'), 0) AS classic_fare,
         coalesce(sum(fare) FILTER (rideable_type = 'electric_bike'), 0) AS electric_fare
  FROM prefixes GROUP BY ALL
),
kpis AS (
  SELECT c.date, c.k, c.i + 1 AS completed, strftime(clock_at, '%I:%M %p') AS clock,
         {_cents("fare")} AS revenue, classic_rides, electric_rides,
         {rpr("classic")}, {rpr("electric")}, {_steady("mean_bar")} AS mean_bar,
         s.station AS top_start_station, s.rides AS top_start_rides,
         e.station AS top_end_station, e.rides AS top_end_rides
  FROM clocks c
  JOIN sums USING (date, k)
  JOIN bars USING (date, k)
  LEFT JOIN start_top s ON s.date = c.date AND s.k = c.k
  LEFT JOIN end_top e ON e.date = c.date AND e.k = c.k
)"""


def oracles() -> dict[str, str]:
    """SQL by query name, for every query that SQL can express."""
    rides, weather = f"WITH {_RIDES}", f"WITH {_WEATHER}"
    priced, training, snaps = f"WITH {_PRICED}", f"WITH {_TRAINING}", f"WITH {_SNAPSHOTS}"
    table = f"{_CLEAN_TABLE}, cast(started_at AS date) AS date FROM clean"
    hours = f"""SELECT date_trunc('hour', started_at) AS hour, rideable_type,
  count(ride_id) AS rides, {_REVENUE} AS revenue"""
    rounded = ", ".join(f"{_fixed(c, 2)} AS {c}" for c in _MEASURES)
    per_type = f"""SELECT rideable_type, {_REVENUE} AS revenue, count(*) AS count,
  {_PER_RIDE} AS rpr FROM priced GROUP BY rideable_type"""
    day_rpr = f"""SELECT date, rideable_type,
  {_cents("coalesce(sum(fare), 0)", "count(*)")} AS rpr FROM priced GROUP BY date, rideable_type"""
    counted = "count(ride_id) AS rides FROM rides"
    return {
        "csv_typed_roundtrip": f"{rides} SELECT * REPLACE ({_FLOAT_COORDS}) FROM rides",
        "csv_inferred_roundtrip": f"{rides} SELECT * FROM rides",
        "weather_inferred_roundtrip": f"""{weather}
SELECT * REPLACE (cast(datetime AS date) AS datetime) FROM weather""",
        "weather_daily": f"{weather} SELECT * REPLACE ({_FLOAT_WEATHER}) FROM weather",
        "serving_scan": f"{rides} SELECT * FROM rides",
        "publish_ride_json": f"{rides} SELECT * FROM rides",
        "publish_weather_json": f"{weather} SELECT * REPLACE ({_FLOAT_WEATHER}) FROM weather",
        "publish_partitioned": f"""{priced}, {_CLEAN}
SELECT ride_id, cast(NULL AS double) AS duration, 0 AS partition FROM rides
UNION ALL SELECT ride_id, duration_seconds, 1 FROM clean""",
        "publish_ordered": f"""{rides} SELECT ride_id,
  row_number() OVER (ORDER BY started_at NULLS FIRST, ride_id NULLS FIRST) - 1 AS position
FROM rides""",
        "ride_table_ddl": table,
        "table_mixed_writers": table,
        "table_day_scan": f"{table} WHERE cast(started_at AS date) = date '{DAY}'",
        "table_weather_days": f"""{priced}, {_CLEAN}, {_WEATHER}, counts AS (
  SELECT cast(started_at AS date) AS date, count(*) AS count FROM clean
  WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL GROUP BY 1
), rainy AS (SELECT * REPLACE ({_FLOAT_WEATHER}) FROM weather WHERE conditions = 'Rain')
SELECT * FROM counts JOIN rainy ON date = cast(datetime AS date)""",
        "weather_table_ddl": f"{weather} SELECT * REPLACE ({_FLOAT_WEATHER}) FROM weather",
        "rides_future": f"""{rides} SELECT * FROM rides
WHERE started_at > timestamp '{CURRENT_AFTER}' ORDER BY started_at, ride_id""",
        "rides_past": f"""WITH {_PAST} SELECT * FROM past_rides
WHERE started_at > timestamp '{PAST_AFTER}' AND started_at < timestamp '{PAST_BEFORE}'
ORDER BY started_at, ride_id""",
        "weather_future": f"""{weather} SELECT * FROM weather
WHERE datetime > timestamp '2023-12-31'""",
        "weather_past": f"""WITH {_PAST} SELECT * FROM past_weather
WHERE datetime > timestamp '{PAST_AFTER}' AND datetime < timestamp '{PAST_BEFORE}'""",
        "weather_limit": f"""WITH {_PAST} SELECT * FROM past_weather
ORDER BY datetime LIMIT {SERVED_DAYS}""",
        "weather_rounded": f"{weather} SELECT * REPLACE ({rounded}) FROM weather",
        "weather_labels": f"""{weather}
SELECT cast(datetime AS date) AS date, strftime(datetime, '%A, %d %B %Y') AS day_label, conditions,
  {_text("tempmax")} || '°C to ' || {_text("tempmin")} || '°C' AS temp,
  {_text("precip")} || 'mm' AS precip, {_text("windgust")} || 'm/s' AS windgust,
  {_text("humidity")} || '%' AS humidity
FROM weather""",
        "parse_ride_json": f"{rides} SELECT * FROM rides",
        "clean_rides": f"{priced}, {_CLEAN} SELECT * FROM clean",
        "rides_complete": f"""{rides} SELECT *, cast(started_at AS date) AS date FROM rides
WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL""",
        "ride_duration": f"""{priced}
SELECT ride_id, started_at, ended_at, duration_seconds FROM timed""",
        "ride_revenue": f"""{priced}
SELECT ride_id, member_casual, rideable_type, duration_seconds, revenue FROM priced""",
        "ride_coords": f"{rides} SELECT ride_id, {_COORDS} FROM rides",
        "rides_on_day": f"""{priced}
SELECT * EXCLUDE (date, fare) FROM priced WHERE date = date '{DAY}'
ORDER BY started_at, ride_id""",
        "rides_distinct": f"{rides} SELECT DISTINCT * FROM rides",
        "union_distinct_rides": f"""{rides}
SELECT * FROM rides WHERE start_station_id IS NOT NULL
UNION SELECT * FROM rides WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL""",
        "dedup_rides_by_key": f"""{rides},
copies AS (
  SELECT * FROM rides
  UNION ALL SELECT * REPLACE (ended_at + INTERVAL 1 MINUTE AS ended_at) FROM rides
  UNION ALL SELECT * REPLACE (cast(NULL AS timestamp) AS started_at) FROM rides
)
SELECT * FROM copies
QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY started_at NULLS LAST, ended_at) = 1""",
        "rides_per_day": f"""{rides}
SELECT cast(started_at AS date) AS date, count(*) AS count FROM rides GROUP BY ALL""",
        "ride_type_distribution": f"""{rides}
SELECT rideable_type, count(*) AS count FROM rides GROUP BY ALL
ORDER BY count DESC, rideable_type""",
        "station_counts_start": f"""{rides} SELECT start_station_name, {counted}
WHERE start_station_name IS NOT NULL GROUP BY ALL""",
        "station_counts_end": f"""{rides} SELECT end_station_name, {counted}
WHERE end_station_name IS NOT NULL GROUP BY ALL""",
        "hourly_rides_revenue": f"{priced} {hours} FROM priced GROUP BY ALL",
        "hourly_mean_line": f"""{priced}
SELECT date, count(*) AS bars, {_steady("avg(rides)")} AS mean_rides
FROM (SELECT date, date_trunc('hour', started_at), rideable_type, count(ride_id) AS rides
      FROM priced GROUP BY ALL) GROUP BY date""",
        "revenue_by_type": f"""{priced} SELECT rideable_type, {_REVENUE} AS revenue
FROM priced GROUP BY ALL""",
        "revenue_total": f"""{priced} SELECT date, count(*) AS rides,
  {_cents("coalesce(sum(fare), 0)")} AS revenue FROM priced GROUP BY date""",
        "revenue_per_ride": f"{priced} {per_type}",
        "revenue_per_ride_wide": f"""{priced}
SELECT date,
  max(CASE WHEN rideable_type = 'classic_bike' THEN rpr END) AS classic_rpr,
  max(CASE WHEN rideable_type = 'electric_bike' THEN rpr END) AS electric_rpr
FROM ({day_rpr}) GROUP BY date""",
        "hex_density": _hexagons(_RIDES, "rides"),
        "snapshot_hex_density": _hexagons(_SNAPSHOTS, "prefixes", "date, k,"),
        "snapshot_arcs": f"""{snaps}
SELECT date, min(k) AS k, ride_id, {_COORDS} FROM prefixes GROUP BY ALL""",
        "od_arcs": f"{rides} SELECT ride_id, {_COORDS} FROM rides",
        "od_flows": f"""{rides}
SELECT start_station_name, end_station_name, count(*) AS rides FROM rides
WHERE start_station_name IS NOT NULL AND end_station_name IS NOT NULL GROUP BY ALL""",
        "snapshot_index": f"{snaps} SELECT date, k, n, i, i + 1 AS completed FROM snaps",
        "snapshot_clock": f"""{snaps}, {_CLOCKS}
SELECT date, k, clock_at, strftime(clock_at, '%I:%M %p') AS clock,
  strftime(date, '%A, %d %B %Y') AS day_label FROM clocks""",
        "snapshot_type_counts": f"""{snaps}
SELECT date, k, rideable_type, count(*) AS rides FROM prefixes GROUP BY ALL""",
        "snapshot_revenue": f"""{snaps}
SELECT date, k, rideable_type, count(*) AS rides, {_REVENUE} AS revenue,
  {_PER_RIDE} AS rpr FROM prefixes GROUP BY date, k, rideable_type""",
        "snapshot_hourly": f"""{snaps}
SELECT date, k, date_trunc('hour', started_at) AS hour, rideable_type,
  count(ride_id) AS rides, {_REVENUE} AS revenue
FROM prefixes GROUP BY date, k, hour, rideable_type""",
        "top_start_station": _top_station("start"),
        "top_end_station": _top_station("end"),
        "snapshot_kpis": f"WITH {_kpis()} SELECT * FROM kpis",
        "snapshot_labels": f"""WITH {_kpis()}
SELECT date, k, clock, {_dollars("revenue")} AS revenue, {_dollars("classic_rpr")} AS classic_rpr,
  {_dollars("electric_rpr")} AS electric_rpr,
  'Average: ' || cast(cast(round_even(mean_bar, 0) AS bigint) AS varchar) || ' rides' AS mean_bar,
  top_start_station, cast(top_start_rides AS varchar) || ' rides' AS top_start_rides,
  top_end_station, cast(top_end_rides AS varchar) || ' rides' AS top_end_rides
FROM kpis""",
        "training_set": f"{training} SELECT * FROM training",
        "training_top5": f"{training} SELECT * FROM training ORDER BY date LIMIT 5",
        "training_features": f"""{training}
SELECT date, {", ".join(_MEASURES)}, count FROM training""",
        "training_split": f"""{training}
SELECT date, count, CASE WHEN datediff('day', date '1970-01-01', date) % 5 = 0
                         THEN 'test' ELSE 'train' END AS part FROM training""",
        "forecast_fit": f"""{training}
SELECT date, CASE WHEN datediff('day', date '1970-01-01', date) % 5 = 0
                  THEN 'test' ELSE 'train' END AS part, count, true AS plausible FROM training""",
        "forecast_trees": f"""{training}
SELECT date, CASE WHEN datediff('day', date '1970-01-01', date) % 5 = 0
                  THEN 'test' ELSE 'train' END AS part, count, true AS same, true AS learnt FROM training""",
        "daily_forecast": f"""{weather}
SELECT cast(datetime AS date) AS date, true AS plausible, true AS labelled FROM weather
WHERE cast(datetime AS date) >= date '{FORECAST_FROM}'""",
        "forecast_r2": f"{weather} SELECT cast(datetime AS date) AS date, true AS fits FROM weather",
        "forecast_vs_actual": f"""{snaps}
SELECT date, k, i + 1 AS completed, true AS adds_up FROM snaps""",
        "parse_rejects": f"""{rides}
SELECT ride_id, CASE cast(ride_id AS bigint) % 10 WHEN 3 THEN 'not json' WHEN 5 THEN 'end_lng'
  WHEN 7 THEN 'started_at' END AS reason FROM rides""",
        "stream_clean": f"{_CLEAN_TABLE} FROM clean",
        "stream_to_table": table,
        "stream_weather_ingest": f"{weather} SELECT * REPLACE ({_FLOAT_WEATHER}) FROM weather",
        "stream_dedup": f"""{rides} SELECT * REPLACE (
  CASE WHEN cast(ride_id AS bigint) % 10 <> 0 THEN started_at END AS started_at) FROM rides""",
        "stream_snapshots": "WITH "
        + _kpis().replace("FROM timed\n", "FROM timed WHERE start_station_id IS NOT NULL\n")
        + " SELECT * FROM kpis",
        "stream_hourly": f"""{priced} {hours} FROM priced
WHERE start_station_id IS NOT NULL GROUP BY ALL""",
    }
