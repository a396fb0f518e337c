"""The same results in SQL, for a check by another engine. Written from the operators' definitions, on plain pairs,
recursions and windows instead of blocks, cells and carried state."""

from __future__ import annotations

from ..functions.numbers import EPSILON
from ..operators.dsp import EDGE, bandpass_sections
from ..schemas import CHANNELS, STATIONS
from .queries import BAD_EVERY, KEYS, LATE_US, NLTA, NSTA, OFF, ON
from .views import DELAYED_BY, DELAYED_EVERY, MIN_SLICES, RAW_RATES, RECORDING_SAMPLES, RECORDING_US, SLICE_ROWS, START_US

SAMPLES = f"""samples AS MATERIALIZED (
  SELECT event_id AS ingest_seq, ['BHE','BHN','BHZ'][event_id % 3 + 1] AS channel,
    ['GMJI','JAGI','PWJI'][(event_id // 3) % 3 + 1] AS station, event_id // 9 AS idx, event_id // 9 // {RECORDING_SAMPLES} AS rec,
    {START_US} + (event_id // 9) * 40000 AS t_us, ({START_US} + (event_id // 9) * 40000) // 1000000 + 1 AS tick,
    strftime(make_timestamp({START_US} + (event_id // 9 // {RECORDING_SAMPLES}) * {RECORDING_US}), '%Y%m%d_%H%M%S') AS mseed_name,
    round(value - 50, 2) + 0.0 AS data
  FROM events)"""

TIMED = """timed AS (
  SELECT event_id AS ingest_seq, ['BHE','BHN','BHZ'][event_id % 3 + 1] AS channel,
    ['GMJI','JAGI','PWJI'][(event_id // 3) % 3 + 1] AS station, ts, epoch_us(ts) AS t_us, round(value - 50, 2) + 0.0 AS data
  FROM events)"""

HOURLY = TIMED + """, hourly AS (
  SELECT station, channel, epoch_us(date_trunc('hour', ts)) AS t_us, max_by(data, ingest_seq) AS data, max(ingest_seq) AS ingest_seq
  FROM timed GROUP BY ALL)"""

WIDE_COLUMNS = ", ".join(
    f"max(CASE WHEN channel || '_' || station = '{k}' THEN data END) AS {k}" for k in KEYS)
WIDE = SAMPLES + f", wide AS (SELECT tick, t_us, {WIDE_COLUMNS} FROM samples GROUP BY tick, t_us)"
FILLED = ", ".join(f"coalesce({k}, 0.0) AS {k}" for k in KEYS)

LOCAL = f"({RECORDING_SAMPLES})"
FRAMES = SAMPLES + f""", parts AS (
  SELECT mseed_name, rec, station, idx, tick, t_us, list_position(['GMJI','JAGI','PWJI'], station) - 1 AS s, (idx % {LOCAL}) // 25 AS sec,
    max(CASE WHEN channel = 'BHE' THEN data END) AS E_data, max(CASE WHEN channel = 'BHN' THEN data END) AS N_data,
    max(CASE WHEN channel = 'BHZ' THEN data END) AS Z_data
  FROM samples GROUP BY ALL),
rules AS (SELECT *, (rec * 7 + s * 5 + sec * 3) % 11 AS h, (rec * 13 + s * 17 + sec * 5) % 8 AS g FROM parts
  WHERE (rec + s * 2 + sec) % 9 <> 0),
frames AS (
  SELECT mseed_name, station, tick, E_data, N_data, Z_data, strftime(make_timestamp(t_us), '%M:%S') AS time, idx AS x,
    CASE WHEN h = 2 THEN 0 WHEN h > 2 THEN rec * {LOCAL} + sec * 25 - h END AS p_arrival,
    CASE WHEN g >= 5 THEN round(-9.0::DOUBLE - g * 0.0371::DOUBLE - sec * 0.01::DOUBLE, 4) END AS lat,
    CASE WHEN g >= 5 THEN g * 0.25 + s * 0.125 + 111.0 END::DOUBLE AS long,
    CASE WHEN g >= 5 THEN g * 0.0625 + 3.5 END::DOUBLE AS magnitude, CASE WHEN g >= 5 THEN sec * 1.5 + g * 0.25 + 80.0 END::DOUBLE AS depth
  FROM rules),
latest AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY mseed_name, station, tick ORDER BY x DESC) = 1)"""


def _ticks(reset: str) -> str:
    """Complete ticks in order, then one step at a time: what was shown, what starts, what is shown."""
    return FRAMES + f""", ticks AS (
  SELECT mseed_name, tick, row_number() OVER (PARTITION BY mseed_name ORDER BY tick) AS n,
    max(CASE WHEN station = 'GMJI' THEN time END) AS frame_time, {reset} AS reset,
    CASE WHEN max(CASE WHEN station = 'JAGI' THEN lat END) IS NOT NULL THEN 'JAGI'
         WHEN max(CASE WHEN station = 'PWJI' THEN lat END) IS NOT NULL THEN 'PWJI'
         WHEN max(CASE WHEN station = 'GMJI' THEN lat END) IS NOT NULL THEN 'GMJI' END AS station
  FROM latest GROUP BY mseed_name, tick HAVING count(DISTINCT station) = 3),
steps AS (
  SELECT mseed_name, tick, n, frame_time, station, reset, false AS before, station IS NOT NULL AS detected, station IS NOT NULL AS found,
    CASE WHEN station IS NOT NULL THEN tick END AS since
  FROM ticks WHERE n = 1
  UNION ALL
  SELECT t.mseed_name, t.tick, t.n, t.frame_time, t.station, t.reset, p.found, NOT p.found AND t.station IS NOT NULL,
    CASE WHEN p.found THEN NOT t.reset ELSE t.station IS NOT NULL END,
    CASE WHEN NOT p.found AND t.station IS NOT NULL THEN t.tick ELSE p.since END
  FROM steps p JOIN ticks t ON t.mseed_name = p.mseed_name AND t.n = p.n + 1),
alerts AS (SELECT steps.mseed_name, steps.tick, steps.frame_time, steps.station, lat, long, magnitude, depth FROM steps
  JOIN latest USING (mseed_name, tick, station) WHERE detected)"""


PANEL = _ticks("coalesce(max(CASE WHEN station = 'GMJI' THEN p_arrival END), 0) <= 0")
MAP = _ticks("max(lat) IS NULL")


def _text(value: str) -> str:
    return f"regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '')"


def _two(value: str) -> str:
    return _text(f"(floor(({value} + {EPSILON}) * 100 + 0.5) / 100)")


def _points(value: str, order: str) -> str:
    return f"string_agg(printf('%.10f ', {value}), '' ORDER BY {order})"


KM = ("2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.x) - radians(a.x)) / 2), 2) + "
      "cos(radians(a.x)) * cos(radians(b.x)) * pow(sin((radians(b.y) - radians(a.y)) / 2), 2))))")

STATION = """stations AS (
  SELECT s_name AS name, NULL::VARCHAR AS description, (s_suppkey * 37 % 160 - 80)::DOUBLE AS x, (s_suppkey * 91 % 340 - 170)::DOUBLE AS y
  FROM supplier)"""


def _nearest(source: str, as_: str = "") -> str:
    return f"""{as_}pairs AS (SELECT a.name, b.name AS other, {KM} AS km FROM {source} a JOIN {source} b ON a.name <> b.name),
{as_}near AS (SELECT name, other, km, row_number() OVER (PARTITION BY name ORDER BY round(km, 6), other) AS rank FROM {as_}pairs QUALIFY rank <= 3)"""


MOVES = f"""moves AS (
  SELECT ['update','delete','insert'][s_nationkey % 3 + 1] AS op, s_name || CASE WHEN s_nationkey % 3 = 2 THEN 'B' ELSE '' END AS name,
    s_suppkey * 41 % 160 - 80 + 0.25::DOUBLE AS x, s_suppkey * 67 % 340 - 170 + 0.5::DOUBLE AS y
  FROM supplier WHERE s_acctbal < 0),
after AS (SELECT name, x, y FROM stations WHERE name NOT IN (SELECT name FROM moves) UNION ALL SELECT name, x, y FROM moves WHERE op <> 'delete'),
fresh AS (SELECT a.x, a.y FROM after a LEFT JOIN stations s ON s.name = a.name WHERE s.name IS NULL OR s.x <> a.x OR s.y <> a.y),
gone AS (SELECT s.name FROM stations s LEFT JOIN after a ON s.name = a.name WHERE a.name IS NULL OR s.x <> a.x OR s.y <> a.y),
reaches AS (SELECT s.name, s.x, s.y, max(n.km) AS km, count(*) AS n FROM stations s JOIN near n ON n.name = s.name GROUP BY ALL),
touched AS (
  SELECT x, y FROM fresh UNION SELECT s.x, s.y FROM stations s JOIN near n ON n.name = s.name WHERE n.other IN (SELECT name FROM gone)
  UNION SELECT x, y FROM reaches WHERE n < 3
  UNION SELECT a.x, a.y FROM reaches a, fresh b WHERE round({KM}, 6) <= round(a.km, 6))"""


CHANGES = """changes AS (
  SELECT c_custkey AS seq, ['insert','insert','update','update','delete'][(c_custkey * 7 + c_nationkey) % 5 + 1] AS op,
    printf('Supplier#%09d', c_custkey // 10) AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'station ' || c_custkey END AS description,
    (c_custkey * 53 % 170 - 85)::DOUBLE AS x, (c_custkey * 29 % 350 - 175)::DOUBLE AS y
  FROM customer),
judged AS (
  SELECT c.*, coalesce(
      last_value(CASE WHEN op IN ('insert', 'delete') THEN op = 'insert' END IGNORE NULLS)
        OVER (PARTITION BY c.name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      s.name IS NOT NULL) AS present
  FROM changes c LEFT JOIN stations s ON s.name = c.name),
verdicts AS (SELECT *, CASE WHEN op = 'insert' THEN NOT present ELSE present END AS accepted FROM judged)"""

SNAPSHOT = STATION + ", " + CHANGES + """, last_op AS (
  SELECT name, op FROM verdicts WHERE accepted QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1),
last_write AS (
  SELECT name, description, x, y FROM verdicts WHERE accepted AND op <> 'delete'
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1),
snapshot AS (
  SELECT s.name, s.description, s.x, s.y FROM stations s WHERE s.name NOT IN (SELECT name FROM last_op)
  UNION ALL
  SELECT w.name, w.description, w.x, w.y FROM last_write w JOIN last_op o ON o.name = w.name WHERE o.op <> 'delete')"""

COMPONENTS = SAMPLES + f""", parts AS (
  SELECT mseed_name, station, channel, idx % {LOCAL} AS idx, data,
    rec * {RECORDING_US} + {START_US} + ((rec * 3 + (list_position(['BHE','BHN','BHZ'], channel) - 1) * 7
      + (list_position(['GMJI','JAGI','PWJI'], station) - 1) * 5) % 10) * 30000 AS start_us
  FROM samples),
starts AS (
  SELECT mseed_name, station, channel, CASE channel WHEN 'BHE' THEN 'e' WHEN 'BHN' THEN 'n' ELSE 'z' END AS label,
    min(start_us) AS start_us, max(idx) + 1 AS npts FROM parts GROUP BY ALL)"""

OFFSETS = COMPONENTS + """, firsts AS (SELECT mseed_name, station, min(start_us) AS first_us FROM starts GROUP BY ALL),
offsets AS (
  SELECT s.*, round_even((start_us - first_us) * 25 / 1000000.0, 0)::BIGINT AS off,
    (SELECT min(label) FROM starts f WHERE f.mseed_name = s.mseed_name AND f.station = s.station AND f.start_us = firsts.first_us) AS first_label
  FROM starts s JOIN firsts USING (mseed_name, station))"""

STATION_OFFSETS = COMPONENTS + """, own AS (
  SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY mseed_name, station ORDER BY start_us, channel) = 1),
moved AS (
  SELECT mseed_name, station, channel, npts, min(start_us) OVER (PARTITION BY mseed_name) AS first_us,
    round_even((start_us - min(start_us) OVER (PARTITION BY mseed_name)) * 25 / 1000000.0, 0)::BIGINT AS off FROM own)"""

RATES = " ".join(f"WHEN '{s}' THEN {r}" for s, r in RAW_RATES.items())
RAW = SAMPLES + f", raw AS (SELECT station, channel, idx, data, (CASE station {RATES} END)::DOUBLE AS fs FROM samples)"


def _resample(keys: str, source: str, exact: bool = False) -> str:
    if exact:
        count, num, den = "floor((n - 1) * 25 / fs)::BIGINT + 1", "fs::BIGINT", "25"
    else:
        count, num, den = "ceil(n * 25 / fs)::BIGINT", "(n - 1)", "greatest(m - 1, 1)"
    return f"""traces AS (SELECT {keys}, max(fs) AS fs, count(*) AS n, list(data ORDER BY idx) AS a FROM {source} GROUP BY {keys}),
sized AS (SELECT *, {count} AS m FROM traces),
points AS (SELECT {keys}, a, n, m, unnest(range(m)) AS j, fs FROM sized),
placed AS (SELECT {keys}, a, n, j, j * {num} // {den} AS i, (j * {num} % {den}) / ({den})::DOUBLE AS f FROM points)
SELECT {keys}, j AS idx, round((1 - f) * a[i + 1] + f * a[least(i + 2, n)], 9) + 0.0 AS data FROM placed"""


def _bandpass(keys: list[str], source: str, rates: list[float]) -> str:
    """Five second-order sections stepped sample by sample, forward and backward, over the extended trace."""
    order = len(bandpass_sections(rates[0]))
    names = ["fs"] + [f"{c}{i}" for i in range(order) for c in ("g", "a", "b")]
    values = ", ".join("(" + ", ".join(repr(float(v)) + "::DOUBLE" for v in [r, *bandpass_sections(r).ravel()]) + ")" for r in rates)
    k = ", ".join(keys)
    on = " AND ".join(f"e.{c} = f.{c}" for c in keys)
    states = [f"{s}{i}" for i in range(order) for s in ("p", "q")]

    def chain(first: bool) -> tuple[str, str]:
        """Outputs of the sections at one sample, and the states after it."""
        outs, after, x = [], [], "e.x"
        for i in range(order):
            p, q = (("(-g0 * e.x)", "(-g0 * e.x)") if i == 0 else ("0.0::DOUBLE", "0.0::DOUBLE")) if first else (f"f.p{i}", f"f.q{i}")
            y = f"(g{i} * {x} + {p})"
            outs.append(f"{y} AS y{i}")
            after.append(f"{q} - a{i} * y{i} AS p{i}, -g{i} * {x} - b{i} * y{i} AS q{i}")
            x = f"y{i}"
        return ", ".join(f"{o}" for o in outs), ", ".join(after)

    def one_pass(name: str, inputs: str) -> str:
        o1, s1 = chain(True)
        o2, s2 = chain(False)
        ys = ", ".join(f"y{i}" for i in range(order))
        st = ", ".join(states)
        ek = ", ".join(f"e.{c}" for c in keys)
        last = f"y{order - 1}"
        return f"""{name} AS (
  SELECT {k}, pos, y, {st} FROM (SELECT {ek}, e.pos, {o1}, {s1}, {last} AS y FROM {inputs} e JOIN coef USING (fs) WHERE e.pos = 0)
  UNION ALL
  SELECT {k}, pos, y, {st} FROM (SELECT {ek}, e.pos, {o2}, {s2}, {last} AS y FROM {name} f
    JOIN {inputs} e ON {on} AND e.pos = f.pos + 1 JOIN coef USING (fs)))""" if ys else ""

    return f"""coef({', '.join(names)}) AS (VALUES {values}),
arrays AS (SELECT {k}, max(fs) AS fs, count(*) AS n, list(data ORDER BY idx) AS a FROM {source} GROUP BY {k}),
ext AS MATERIALIZED (
  SELECT {k}, fs, n, pos, CASE WHEN pos < {EDGE} THEN 2 * a[1] - a[{EDGE} - pos + 1] WHEN pos < n + {EDGE} THEN a[pos - {EDGE} + 1]
      ELSE 2 * a[n] - a[2 * n + {EDGE} - 1 - pos] END AS x
  FROM (SELECT *, unnest(range(n + 2 * {EDGE})) AS pos FROM arrays)),
{one_pass('forward', 'ext')},
back AS MATERIALIZED (
  SELECT {', '.join('e.' + c for c in keys)}, e.fs, e.n, e.n + 2 * {EDGE} - 1 - e.pos AS pos, f.y AS x
  FROM forward f JOIN ext e ON {on} AND e.pos = f.pos),
{one_pass('backward', 'back')},
done AS (SELECT {', '.join('e.' + c for c in keys)}, e.n + {EDGE} - 1 - e.pos AS idx, f.y AS filtered
  FROM backward f JOIN back e ON {on} AND e.pos = f.pos WHERE e.n + {EDGE} - 1 - e.pos BETWEEN 0 AND e.n - 1)"""


def _ratios(keys: list[str], source: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = r.{c}" for c in keys)
    sk = ", ".join(f"s.{c}" for c in keys)
    return f"""rec AS (
  SELECT {k}, idx, 0.0::DOUBLE AS sta, 1e-99::DOUBLE AS lta FROM {source} WHERE idx = 0
  UNION ALL
  SELECT {sk}, s.idx, r.sta + (s.data * s.data - r.sta) / {NSTA}, r.lta + (s.data * s.data - r.lta) / {NLTA}
  FROM rec r JOIN {source} s ON {on} AND s.idx = r.idx + 1),
ratios AS (SELECT {k}, idx, CASE WHEN idx < {NLTA} OR lta <= 0 THEN 0.0 ELSE sta / lta END AS ratio FROM rec),
runs AS (SELECT *, sum(CASE WHEN ratio <= {OFF} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY idx) AS run FROM ratios),
intervals AS (
  SELECT {k}, min(CASE WHEN ratio > {ON} THEN idx END) AS on_idx, max(idx) AS off_idx FROM runs WHERE ratio > {OFF}
  GROUP BY {k}, run HAVING max(ratio) > {ON})"""


RECORDINGS = SAMPLES + f", local AS MATERIALIZED (SELECT mseed_name, station, channel, idx % {LOCAL} AS idx, data FROM samples)"
PICKS = RECORDINGS + ", " + _ratios(["mseed_name", "station", "channel"], "local") + """, arrivals AS (
  SELECT r.mseed_name, r.station, min(CASE WHEN on_idx > 0 THEN on_idx END) AS p_arrival
  FROM (SELECT DISTINCT mseed_name, station FROM local) r LEFT JOIN intervals i ON i.mseed_name = r.mseed_name AND i.station = r.station
  GROUP BY ALL)"""

TRACES = SAMPLES + """, traces AS (
  SELECT mseed_name AS file, station, channel, (list_position(['GMJI','JAGI','PWJI'], station) - 1) * 3
      + list_position(['BHE','BHN','BHZ'], channel) - 1 AS trace_no, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS npts,
    list(CASE WHEN idx % 50 <> 0 THEN data END / 100000 ORDER BY idx) AS scaled, list(data ORDER BY idx) AS a
  FROM samples GROUP BY mseed_name, station, channel)"""

CUT = f"CASE WHEN event_id % {BAD_EVERY} = 0 THEN substr(props, 1, 4) ELSE props END"


def all_oracles() -> dict[str, str]:
    w, r = "WITH ", "WITH RECURSIVE "
    json_series = " UNION ALL ".join(
        f"SELECT tick, '{k}' AS series, t_us, coalesce(CAST({k} AS VARCHAR), 'null') AS v FROM wide" for k in KEYS)
    json_series += " UNION ALL SELECT tick, '_time', t_us, CAST(t_us // 1000 AS VARCHAR) FROM wide"
    zipped = SAMPLES + ", zipped AS (SELECT station, t_us, tick, " + ", ".join(
        f"max(CASE WHEN channel = '{c}' THEN data END) AS {c}" for c in CHANNELS) + " FROM samples GROUP BY ALL)"
    aligned = ", ".join(f"max(CASE WHEN label = '{c}' THEN data END) AS {c}" for c in "enz")
    padded = ", ".join(f"max(CASE WHEN station = '{s}' THEN data END) AS {s}" for s in STATIONS)
    return {
        "frame_1s_wide": f"{w}{WIDE} SELECT tick, t_us, {FILLED} FROM wide",
        "frame_unpivot": f"{w}{SAMPLES} SELECT t_us, channel, station, data FROM samples",
        "frame_regroup": f"{w}{SAMPLES} SELECT tick, station, channel, count(*) AS n, {_points('data', 't_us')} AS points FROM samples GROUP BY ALL",
        "frame_nested": f"""{w}{SAMPLES} SELECT tick, count(DISTINCT station) AS n_stations, count(DISTINCT station || channel) AS n_series,
  {", ".join(f"string_agg(printf('%.10f ', data), '' ORDER BY t_us) FILTER (WHERE channel || '_' || station = '{k}') AS {k}" for k in KEYS)}
FROM samples GROUP BY tick""",
        "frame_map": f"""{w}{SAMPLES} SELECT t_us, count(*) AS n, {WIDE_COLUMNS} FROM samples GROUP BY t_us""",
        "frame_channel_zip": f"{w}{zipped} SELECT station, t_us, BHE, BHN, BHZ FROM zipped",
        "frame_json": f"""{w}{WIDE}, long AS ({json_series}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tick, series ORDER BY t_us) - 1 AS n FROM long)
SELECT tick, series, '{{' || string_agg('"' || n || '":' || v, ',' ORDER BY n) || '}}' AS json FROM numbered GROUP BY tick, series""",
        "rolling_buffer": f"""{w}{zipped}, own AS (SELECT DISTINCT station, tick FROM zipped)
SELECT o.station, o.tick, greatest(100 - (o.tick - {START_US // 1_000_000}) * 25, 0) AS padding, count(*) AS n, min(z.t_us) AS first_us,
  {", ".join(f"string_agg(coalesce(printf('%.10f ', z.{c}), 'None '), '' ORDER BY z.t_us) AS {c.lower()}" for c in CHANNELS)}
FROM own o JOIN zipped z ON z.station = o.station AND z.tick BETWEEN o.tick - 3 AND o.tick GROUP BY o.station, o.tick""",
        "replay_ticks": f"""{w}{SAMPLES}, ticks AS (SELECT unnest(range({START_US // 1_000_000}, (SELECT max(tick) + 1 FROM samples))) AS tick)
SELECT k.tick, count(s.tick) AS n_rows, count(DISTINCT s.station || s.channel) AS n_channels
FROM ticks k LEFT JOIN samples s ON s.tick = k.tick GROUP BY k.tick""",
        "station_filter": f"{w}{SAMPLES} SELECT mseed_name, station, channel, idx, data FROM samples WHERE station IN ('GMJI', 'PWJI')",
        "recording_filter": f"{w}{SAMPLES} SELECT mseed_name, station, channel, idx, data FROM samples WHERE mseed_name = '20150820_151201'",
        "time_range": f"""{w}{TIMED} SELECT ingest_seq, t_us, data FROM timed
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'""",
        "latest_row": f"{w}{FRAMES} SELECT mseed_name, station, tick, x, time, E_data, N_data, Z_data, p_arrival, lat FROM latest",
        "complete_ticks": f"{w}{FRAMES} SELECT mseed_name, tick FROM frames GROUP BY ALL HAVING count(DISTINCT station) = 3",
        "samples_last_write": f"{w}{HOURLY} SELECT * FROM hourly",
        "sample_table": f"""{w}{HOURLY} SELECT * FROM hourly
WHERE t_us >= epoch_us(TIMESTAMP '2024-01-02 12:00:00') AND t_us < epoch_us(TIMESTAMP '2024-01-09 12:00:00')""",
        "snap_time": f"""{w}{TIMED} SELECT ingest_seq, (t_us + 20000) // 40000 * 40000 AS snapped_us,
  (t_us + 25000) // 50000 * 50000 AS snapped_20hz_us FROM timed""",
        "explode_samples": f"""{w}{TRACES}, rows AS (SELECT *, start_us + trace_no * 7003 AS late FROM traces),
points AS (SELECT *, unnest(range(npts)) AS j FROM rows)
SELECT station, channel, j AS sample_no, (late + 20000) // 40000 * 40000 + j * 40000 AS t_us, late AS trace_start_us, a[j + 1] AS data FROM points""",
        "trace_qc": f"""{w}{SAMPLES} SELECT station, channel, count(*) AS npts, min(t_us) AS start_us, max(t_us) AS end_us,
  round((max(t_us) - min(t_us)) / 1000000.0 / (count(*) - 1), 6) + 0.0 AS delta FROM samples GROUP BY station, channel""",
        "sample_ordinal": f"""{w}{SAMPLES} SELECT station, channel, t_us, row_number() OVER (PARTITION BY station, channel ORDER BY t_us) - 1 AS sample_no
FROM samples""",
        "throughput": f"""{w}{TIMED} SELECT station, channel, count(*) AS n_samples, round((max(t_us) - min(t_us)) / 1000000.0, 6) + 0.0 AS elapsed_s,
  round(count(*) / ((max(t_us) - min(t_us)) / 1000000.0), 6) + 0.0 AS rate FROM timed GROUP BY station, channel""",
        "array_text_roundtrip": f"""{w}{TRACES}, texts AS (
  SELECT file, station, channel, list_transform(scaled, lambda v: CASE WHEN v IS NULL THEN 'None ' ELSE printf('%.10f ', v) END) AS words FROM traces)
SELECT file, station, channel, array_to_string(words, '') AS text, len(words) AS n,
  len(list_filter(words, lambda v: v = 'None ')) AS n_null,
  round(list_sum(list_transform(list_filter(words, lambda v: v <> 'None '), lambda v: CAST(trim(v) AS DOUBLE))), 8) + 0.0 AS total FROM texts""",
        "trace_document": f"""{w}{TRACES}, texts AS (SELECT *, list_sum(list_transform(a, lambda v: length(printf('%.10f ', v))))::BIGINT AS size FROM traces)
SELECT file AS name, count(*) AS n_traces, string_agg(trace_no || ':IA:' || station || ':' || channel || ':' || npts || ':'
  || strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z:' || size, ',' ORDER BY trace_no) AS traces
FROM texts GROUP BY file""",
        "trace_metadata": f"""{w}{TRACES} SELECT 'IA' AS network, station, channel, '' AS location, start_us, end_us, 0.04::DOUBLE AS delta, npts,
  1.0::DOUBLE AS calib, 25.0::DOUBLE AS sampling_rate FROM traces""",
        "pair_distance": f"""{w}{STATION}, {_nearest('stations')}, linked AS (
  SELECT least(name, other) AS a, greatest(name, other) AS b, any_value(km) AS km FROM near GROUP BY ALL)
SELECT a AS name, b AS other, round(km, 3) + 0.0 AS km FROM linked UNION ALL SELECT b, a, round(km, 3) + 0.0 FROM linked""",
        "nearest3": f"{w}{STATION}, {_nearest('stations')} SELECT name, rank, other, round(km, 3) + 0.0 AS km FROM near",
        "station_changes": f"""{w}{SNAPSHOT}, {_nearest('snapshot')}
SELECT s.name, s.description, s.x, s.y, coalesce(string_agg(n.other, ',' ORDER BY n.rank), '') AS closest
FROM snapshot s LEFT JOIN near n ON n.name = s.name GROUP BY s.name, s.description, s.x, s.y""",
        "station_refresh": f"""{w}{STATION}, {_nearest('stations')}, {MOVES}, {_nearest('after', 'new_')}
SELECT a.name, a.x, a.y, (SELECT string_agg(n.other, ',' ORDER BY n.rank) FROM new_near n WHERE n.name = a.name) AS closest,
  CASE WHEN EXISTS (SELECT 1 FROM touched t WHERE t.x = a.x AND t.y = a.y) THEN 1 ELSE 0 END::BIGINT AS recomputed
FROM after a""",
        "station_as_of": f"""{w}{STATION}, {CHANGES}, ends AS (SELECT coalesce(max(seq), 0) AS last FROM changes),
asked AS (SELECT name, seq FROM changes UNION SELECT name, seq - 1 FROM changes UNION SELECT name, unnest([0, last // 2, last + 1]) FROM stations, ends),
writes AS (SELECT name, seq, op, description, x, y FROM verdicts WHERE accepted UNION ALL SELECT name, -9, 'insert', description, x, y FROM stations),
latest AS (SELECT a.name, a.seq, w.op IN ('insert', 'update') AS held, w.description, w.x, w.y FROM asked a
  LEFT JOIN writes w ON w.name = a.name AND w.seq <= a.seq
  QUALIFY row_number() OVER (PARTITION BY a.name, a.seq ORDER BY w.seq DESC NULLS LAST) = 1)
SELECT name, seq, CASE WHEN held THEN 1 ELSE 0 END::BIGINT AS found, CASE WHEN held THEN description END AS description,
  CASE WHEN held THEN x END AS x, CASE WHEN held THEN y END AS y FROM latest""",
        "station_rejections": f"""{w}{STATION}, {CHANGES} SELECT seq, op, name, CASE WHEN op = 'insert' THEN 'exists' ELSE 'not found' END AS reason
FROM verdicts WHERE NOT accepted""",
        "station_lookup": f"""{w}{STATION}, {CHANGES}, asked AS (SELECT DISTINCT name FROM changes)
SELECT a.name, CASE WHEN s.name IS NULL THEN 0 ELSE 1 END::BIGINT AS found, s.x, s.y FROM asked a LEFT JOIN stations s ON s.name = a.name""",
        "station_exists": f"""{w}{STATION}, {CHANGES} SELECT seq, name, CASE WHEN name IN (SELECT name FROM stations) THEN 'exists' ELSE 'new' END AS outcome
FROM changes WHERE op = 'insert'""",
        "station_list": f"""{w}{STATION}, {_nearest('stations')}
SELECT s.name, s.description, s.x, s.y, string_agg(n.other, ',' ORDER BY n.rank) AS closest
FROM stations s JOIN near n ON n.name = s.name GROUP BY s.name, s.description, s.x, s.y""",
        "trace_order": f"""{w}{COMPONENTS} SELECT mseed_name, station, string_agg(start_us || ':' || channel, ',' ORDER BY start_us, channel) AS traces
FROM starts GROUP BY mseed_name, station""",
        "component_offsets": f"""{w}{OFFSETS} SELECT mseed_name, station, first_label, string_agg(label || ':' || off, ',' ORDER BY label) AS offsets
FROM offsets GROUP BY ALL""",
        "component_align": f"""{w}{OFFSETS}, moved AS (
  SELECT mseed_name, station, label, idx + off AS idx, data FROM parts JOIN offsets USING (mseed_name, station, channel)
  UNION ALL SELECT mseed_name, station, label, unnest(range(off)), 0.0 FROM offsets)
SELECT mseed_name, station, idx, {aligned} FROM moved GROUP BY mseed_name, station, idx""",
        "station_align": f"{w}{STATION_OFFSETS} SELECT mseed_name, station, channel, off AS \"offset\", first_us AS first_start_us FROM moved",
        "station_pad": f"""{w}{STATION_OFFSETS} SELECT mseed_name, idx + off AS idx, {padded}
FROM parts JOIN moved USING (mseed_name, station, channel) GROUP BY mseed_name, idx + off""",
        "resample_25hz": f"{w}{RAW}, {_resample('station, channel', 'raw')}",
        "resample_exact": f"{w}{RAW}, {_resample('station, channel', 'raw', exact=True)}",
        "resample_arrays": f"""{w}{SAMPLES}, raw AS (SELECT mseed_name AS file, station, channel, idx, data, (CASE station {RATES} END)::DOUBLE AS fs FROM samples),
{_resample('file, station, channel', 'raw')}""",
        "bandpass": f"""{r}{RAW}, {_bandpass(['station', 'channel'], 'raw', list(RAW_RATES.values()))}
SELECT station, channel, idx, round(filtered, 6) + 0.0 AS filtered FROM done""",
        "ingest_25hz": f"""{r}{SAMPLES}, raw AS (SELECT *, 25.0::DOUBLE AS fs FROM samples), {_bandpass(['mseed_name', 'station', 'channel'], 'raw', [25.0])}
SELECT mseed_name, station, channel, idx, round(filtered, 6) + 0.0 AS filtered FROM done""",
        "sta_lta": f"""{r}{SAMPLES}, {_ratios(['station', 'channel'], 'samples')}
SELECT station, channel, idx, round(ratio, 6) + 0.0 AS ratio FROM ratios""",
        "trigger_onset": f"{r}{SAMPLES}, {_ratios(['station', 'channel'], 'samples')} SELECT station, channel, on_idx, off_idx FROM intervals",
        "p_arrival": f"{r}{PICKS} SELECT mseed_name, station, p_arrival FROM arrivals",
        "p_window": f"""{r}{PICKS} SELECT s.mseed_name, s.station, s.channel, p.p_arrival, s.idx - p.p_arrival AS rel, s.data
FROM local s JOIN arrivals p ON p.mseed_name = s.mseed_name AND p.station = s.station AND s.idx BETWEEN p.p_arrival - 25 AND p.p_arrival + 24""",
        "prediction_present": f"{w}{FRAMES} SELECT mseed_name, station, tick, x, lat FROM frames WHERE lat IS NOT NULL",
        "first_detection": f"{r}{PANEL} SELECT mseed_name, tick, station, lat FROM alerts",
        "first_detection_map": f"{r}{MAP} SELECT mseed_name, tick, station, lat FROM alerts",
        "countdown": f"{r}{PANEL} SELECT mseed_name, tick, since, greatest(24 - (tick - since), 0) AS countdown FROM steps WHERE found",
        "alert_text": f"""{r}{PANEL} SELECT mseed_name, tick, station AS receiver,
  substr({_text('lat')}, 1, 5) || ',' || substr({_text('long')}, 1, 5) AS location, substr({_text('magnitude')}, 1, 3) AS magnitude,
  substr({_text('depth')}, 1, 5) AS depth, substr(mseed_name, 10, 2) || ':' || frame_time || ' ' || substr(mseed_name, 7, 2) || '/'
  || substr(mseed_name, 5, 2) || '/' || substr(mseed_name, 1, 4) AS origin,
  'Koordinat: ' || {_two('lat')} || ',' || {_two('long')} || ' Magnitude; ' || {_two('magnitude')} || ' Kedalaman: ' || {_two('depth')}
  || ' KM' || ' Stasiun Pendeteksi: ' || station AS popup FROM alerts""",
        "latency": f"""{w}{TIMED}, late AS (SELECT strftime(ts, '%Y-%m-%d') AS day,
  (t_us + floor((data + 60) * 100)::BIGINT * 1000) // 1000 - t_us // 1000 AS ms FROM timed)
SELECT day, count(*) AS n, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms
FROM late GROUP BY day""",
        "event_decode": f"""{w}texts AS (SELECT event_id, {CUT} AS value FROM events)
SELECT event_id, CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.k') AS BIGINT) END AS k,
  CASE WHEN NOT json_valid(value) THEN value END AS raw FROM texts""",
        "event_json": f"""{w}{SAMPLES} SELECT station, channel, strftime(make_timestamp(min(t_us) OVER (PARTITION BY mseed_name, station, channel)),
  '%Y-%m-%d %H:%M:%S.%f') AS time, data, idx % {LOCAL} AS sample_no, 1::BIGINT AS stamped FROM samples""",
        "binary_errors": f"""{w}{TRACES}, records AS (SELECT file, trace_no, npts, trace_no % 3 = 0 AS doubled FROM traces),
  placed AS (SELECT *, row_number() OVER o - 1 + count(*) FILTER (WHERE doubled) OVER o AS last_no FROM records
    WINDOW o AS (PARTITION BY file ORDER BY trace_no ROWS UNBOUNDED PRECEDING))
SELECT file, sum(npts)::BIGINT AS n_samples, count(*) FILTER (WHERE doubled) AS n_errors, coalesce(sum(last_no) FILTER (WHERE doubled), 0)::BIGINT AS record_nos
FROM placed GROUP BY file""",
        "sample_table_from": f"""{w}{TIMED} SELECT station, channel, t_us, max_by(data, ingest_seq) AS data, max(ingest_seq) AS ingest_seq
FROM timed WHERE ts >= TIMESTAMP '2024-01-09 12:00:00' GROUP BY station, channel, t_us""",
        "sample_table_until": f"""{w}{TIMED} SELECT station, channel, t_us, max_by(data, ingest_seq) AS data, max(ingest_seq) AS ingest_seq
FROM timed WHERE ts < TIMESTAMP '2024-01-09 12:00:00' GROUP BY station, channel, t_us""",
        "binary_ingest": f"""{w}{SAMPLES} SELECT mseed_name, station, channel, idx % {LOCAL} AS sample_no, t_us, data FROM samples""",
        "binary_samples": f"{w}{SAMPLES} SELECT mseed_name, station, channel, idx % {LOCAL} AS idx, t_us, data FROM samples",
        "binary_splits": f"""{w}{SAMPLES} SELECT 'part-' || (idx // (16 * {LOCAL})) AS file, station, channel, 1::BIGINT AS segment,
  idx % (16 * {LOCAL}) AS idx, t_us, data FROM samples""",
        "stream_frame": f"{w}{WIDE} SELECT tick, t_us, {', '.join(KEYS)} FROM wide",
        "stream_sliding": f"""{w}{SAMPLES}, shown AS (SELECT *, unnest(range(tick, tick + 4)) AS seen FROM samples)
SELECT seen AS tick, station, channel, count(*) AS n, {_points('data', 't_us')} AS points FROM shown
GROUP BY seen, station, channel""",
        "stream_picks": f"""{r}{SAMPLES}, {_ratios(['station', 'channel'], 'samples')}, ends AS (SELECT station, channel, max(idx) AS last FROM samples GROUP BY ALL)
SELECT station, channel, 'on' AS event, {START_US} + on_idx * 40000 AS t_us FROM intervals
UNION ALL SELECT station, channel, 'off', {START_US} + off_idx * 40000 FROM intervals JOIN ends USING (station, channel) WHERE off_idx < last""",
        "stream_alert": f"""{r}{PANEL} SELECT mseed_name, tick, 'detected' AS event, station FROM steps WHERE detected
UNION ALL SELECT mseed_name, tick, 'reset', NULL FROM steps WHERE before AND reset""",
        "stream_alert_map": f"""{r}{MAP} SELECT mseed_name, tick, 'detected' AS event, station FROM steps WHERE detected
UNION ALL SELECT mseed_name, tick, 'reset', NULL FROM steps WHERE before AND reset""",
        "stream_alert_expiry": f"""{r}{PANEL}, sent AS (SELECT mseed_name, tick, list(DISTINCT station) AS stations FROM latest GROUP BY ALL)
SELECT mseed_name, tick, 'detected' AS event, station FROM steps WHERE detected
UNION ALL SELECT mseed_name, tick, 'reset', NULL FROM steps WHERE before AND reset
UNION ALL SELECT mseed_name, tick, 'late', unnest(stations) FROM sent WHERE len(stations) < 3""",
        "stream_late": f"""{w}{SAMPLES}, sent AS (SELECT *, ingest_seq + CASE WHEN ingest_seq % {DELAYED_EVERY} = 5 THEN {DELAYED_BY} ELSE 0 END AS sent FROM samples),
bounds AS (SELECT min(sent) AS low, (max(sent) - min(sent)) // greatest({MIN_SLICES}, ceil(count(*) / {SLICE_ROWS}))::BIGINT + 1 AS step FROM sent),
sliced AS (SELECT sent.*, (sent - low) // step AS slice FROM sent, bounds),
newest AS (SELECT slice, max(max(t_us)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_us FROM sliced GROUP BY slice)
SELECT station, channel, t_us, data, CASE WHEN tick <= (newest_us - {LATE_US}) // 1000000 THEN 'late' ELSE 'frame' END AS kind FROM sliced JOIN newest USING (slice)""",
        "sample_compact": f"{w}{HOURLY} SELECT station, channel, t_us, data, ingest_seq FROM hourly",
        "stream_upsert": f"{w}{HOURLY} SELECT station, channel, t_us, data, ingest_seq FROM hourly",
        "stream_replay": f"""{w}{SAMPLES}, ticks AS (SELECT unnest(range({START_US // 1_000_000}, (SELECT max(tick) + 1 FROM samples))) AS tick)
SELECT k.tick, count(s.tick) AS n_rows, count(DISTINCT s.station || s.channel) AS n_channels
FROM ticks k LEFT JOIN samples s ON s.tick = k.tick GROUP BY k.tick""",
        "stream_counts": f"""{w}texts AS (SELECT {CUT} AS value FROM events)
SELECT count(*) FILTER (WHERE json_valid(value)) AS delivered, count(*) FILTER (WHERE NOT json_valid(value)) AS rejected FROM texts""",
        "stream_restart": f"""{w}texts AS (SELECT {CUT} AS value FROM events)
SELECT CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.k') AS BIGINT) END AS k,
  CASE WHEN NOT json_valid(value) THEN value END AS raw, 1::BIGINT AS failures, 1::BIGINT AS idle FROM texts""",
        "ingest_metrics": f"""{w}{TIMED} SELECT count(*) AS n_samples, round((max(t_us) - min(t_us)) / 1000000.0, 6) + 0.0 AS span_s,
  round(count(*) / ((max(t_us) - min(t_us)) / 1000000.0), 6) + 0.0 AS rate FROM timed""",
        "stream_lookup": f"""{w}{SAMPLES}, docs AS (SELECT mseed_name AS name, count(DISTINCT station || channel) AS n_traces FROM samples GROUP BY ALL),
sent AS (SELECT ingest_seq, CASE WHEN ingest_seq % 7 <> 0 THEN mseed_name ELSE 'unknown' END AS mseed_name, mseed_name || '.mseed' AS filename FROM samples)
SELECT ingest_seq, mseed_name, filename, n_traces FROM sent LEFT JOIN docs ON docs.name = sent.mseed_name""",
        "stream_bad_rows": f"""{w}texts AS (SELECT {CUT} AS value FROM events)
SELECT CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.k') AS BIGINT) END AS k,
  CASE WHEN NOT json_valid(value) THEN value END AS raw FROM texts""",
        "stream_lag": f"{w}{SAMPLES} SELECT ingest_seq, station, channel, t_us // 1000 AS event_ms, 1::BIGINT AS lagging FROM samples",
        "stream_ingest": f"""{w}{SAMPLES} SELECT mseed_name AS name, count(DISTINCT station || channel) AS n_traces, count(*) AS n_samples
FROM samples GROUP BY mseed_name""",
    }
