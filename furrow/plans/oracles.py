"""DuckDB SQL for the registered queries, on the same tables.

Every text starts from the same mapping of `events` and `customer` as sources/testbed.py. Means are
quotients of whole-number sums, as there, so both engines divide the same two numbers.
"""

from __future__ import annotations

from furrow import contracts as C


def _list(values: list[str], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST({index} AS INT) + 1]"


def _of(kind: str, value: str) -> str:
    return f"CASE WHEN event_type = '{kind}' THEN {value} END"


def _scaled(base: int, step: int, scale: int) -> str:
    return f"CAST({base} + k * {step} AS DOUBLE) / CAST({scale} AS DOUBLE)"


EV = f"""ev0 AS (
  SELECT CAST(event_id AS VARCHAR) AS event_uuid,
         CASE event_type WHEN 'view' THEN '{C.SATELLITE}' WHEN 'click' THEN '{C.WEATHER}'
              WHEN 'error' THEN '{C.SOIL}' WHEN 'signup' THEN '{C.REPORT}'
              WHEN 'purchase' THEN '{C.MARKET}' END AS event_type,
         ts,
         CASE WHEN event_type <> 'purchase' THEN CAST(user_id AS VARCHAR) END AS plot_id,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         value AS measure
  FROM events),
ev AS (
  SELECT *,
    CASE WHEN event_type IN ('{C.REPORT}', '{C.MARKET}') THEN {_list(C.CROPS, 'k % 7')} END AS crop,
    CASE event_type
      WHEN '{C.SATELLITE}' THEN 'agri.satellite.raw' WHEN '{C.WEATHER}' THEN 'agri.weather.raw'
      WHEN '{C.SOIL}' THEN 'agri.iot.raw' WHEN '{C.REPORT}' THEN 'agri.reports.raw'
      WHEN '{C.MARKET}' THEN 'agri.market.raw' ELSE 'agri.misc.raw' END AS topic,
    {_of(C.SATELLITE, _scaled(200, 6, 1000))} AS ndvi,
    CASE WHEN event_type = '{C.WEATHER}' THEN {_scaled(200, 2, 10)}
         WHEN event_type = '{C.SOIL}' THEN {_scaled(220, 1, 10)} END AS temperature_c,
    {_of(C.WEATHER, _scaled(400, 5, 10))} AS humidity_pct,
    {_of(C.WEATHER, _scaled(0, 50, 100))} AS precipitation_mm,
    {_of(C.WEATHER, _scaled(250, 1, 10))} AS temp_max,
    {_of(C.SOIL, _scaled(200, 4, 10))} AS moisture_pct,
    {_of(C.SOIL, _scaled(550, 2, 100))} AS ph,
    {_of(C.SOIL, _scaled(2000, 20, 10))} AS nitrogen_ppm,
    {_of(C.SOIL, _scaled(1500, 25, 100))} AS phosphorus_ppm,
    {_of(C.SOIL, _scaled(1500, 15, 10))} AS potassium_ppm,
    {_of(C.SOIL, _list(C.SOIL_TYPES, 'k % 4'))} AS soil_type,
    {_of(C.REPORT, _list(C.REPORT_TYPES, 'k % 4'))} AS report_type,
    {_of(C.REPORT, f"'Observed ' || {_list(C.PESTS, 'k % 5')} || ' on ' || "
                   f"{_list(C.CROPS, 'k % 7')}")} AS description,
    {_of(C.REPORT, _list(C.SEVERITIES, 'k % 4'))} AS severity,
    {_of(C.REPORT, _list(C.CHANNELS, 'k % 3'))} AS channel,
    {_of(C.REPORT, _scaled(200, 1, 10))} AS lat,
    {_of(C.MARKET, 'measure')} AS price,
    {_of(C.MARKET, _list(C.MARKETS, 'k % 8'))} AS market_location
  FROM ev0)"""

PLOTS = f"""plots AS (
  SELECT CAST(c_custkey AS VARCHAR) AS plot_id, r_name AS state, n_name AS district,
         {_list(C.CROPS, 'c_custkey % 7')} AS crop_type,
         abs(c_acctbal) / CAST(1000 AS DOUBLE) AS area_hectares, c_name AS farmer_name,
         CAST(c_custkey AS VARCHAR) AS farmer_id
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

CONTACTS = f"""contacts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS farmer_id,
         '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone,
         {_list(C.LANGUAGES, 'c_custkey % 8')} AS preferred_language,
         {_list(['whatsapp', 'sms', 'voice_call', 'sns'], 'c_custkey % 4')} AS preferred_channel
  FROM customer)"""


def _units(x: str) -> str:
    """All digits of a reading as a decimal, by way of its shortest text."""
    return f"CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 18))"


def _double(total: str) -> str:
    """A decimal sum as the double nearest to it."""
    return f"CAST(CAST({total} AS VARCHAR) AS DOUBLE)"


def _whole(x: str) -> str:
    """A sum of readings in units of its last digit."""
    return f"CAST(replace(CAST(sum({_units(x)}) AS VARCHAR), '.', '') AS HUGEINT)"


def _mean(x: str) -> str:
    return (f"CASE WHEN count({x}) > 0 THEN {_double(f'sum({_units(x)})')} / "
            f"CAST(count({x}) AS DOUBLE) END")


def _rounded(total: str, n: str, digits: int) -> str:
    """A mean as text, rounded half up at one or two digits, by whole numbers alone."""
    one = 10 ** digits
    unit = 10 ** 18 // one
    h = f"CAST((2 * {total} + {unit}::HUGEINT * {n}) // (2 * {unit}::HUGEINT * {n}) AS BIGINT)"
    return (f"(CAST({h} // {one} AS VARCHAR) || '.' || "
            f"lpad(CAST({h} % {one} AS VARCHAR), {digits}, '0'))")


HOURLY = f"""hm AS (
  SELECT coalesce(plot_id, 'unknown') AS plot_id, date_trunc('hour', ts) AS window_start,
         date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
         count(ndvi) AS n_ndvi, count(moisture_pct) AS n_moisture, count(temperature_c) AS n_temp,
         {_whole('ndvi')} AS s_ndvi,
         {_whole('moisture_pct')} AS s_moisture,
         {_whole('temperature_c')} AS s_temp,
         {_mean('ndvi')} AS avg_ndvi, {_mean('moisture_pct')} AS avg_moisture,
         {_mean('temperature_c')} AS avg_temp
  FROM src WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}')
  GROUP BY 1, 2, 3)"""
ALERTS = f"""{HOURLY},
alerts AS (
  SELECT plot_id, window_end, 'low_vegetation_health' AS alert_type, 'high' AS severity,
         'Low NDVI detected: ' || {_rounded('s_ndvi', 'n_ndvi', 2)} AS message
  FROM hm WHERE avg_ndvi < 0.3
  UNION ALL
  SELECT plot_id, window_end, 'low_soil_moisture', 'critical',
         'Irrigation needed: moisture at ' || {_rounded('s_moisture', 'n_moisture', 1)} || '%'
  FROM hm WHERE avg_moisture < 25
  UNION ALL
  SELECT plot_id, window_end, 'heat_stress', 'medium',
         'Heat stress warning: ' || {_rounded('s_temp', 'n_temp', 1)} || '°C'
  FROM hm WHERE avg_temp > 38)"""
SRC_ALL = "src AS (SELECT * FROM ev)"
BASE = f"WITH {EV}"
ALERT_BASE = f"{BASE}, {SRC_ALL}, {ALERTS}"


def _alert_id(plot: str, kind: str, ts: str, message: str) -> str:
    return f"sha256(concat_ws('|', {plot}, {kind}, CAST({ts} AS VARCHAR), {message}))"


MESSAGES = f"""{PLOTS},
msg AS (
  SELECT {_alert_id('a.plot_id', 'alert_type', 'window_end', 'message')} AS alert_id,
         a.plot_id, alert_type, severity, message AS message_en,
         CAST(NULL AS VARCHAR) AS message_local, 'en' AS language,
         CASE alert_type WHEN 'low_vegetation_health' THEN '' WHEN 'heat_stress' THEN 'email'
              ELSE 'whatsapp' END AS channel,
         window_end AS ts, p.farmer_id
  FROM alerts a LEFT JOIN plots p ON a.plot_id = p.plot_id)"""
MSG_BASE = f"{ALERT_BASE}, {MESSAGES}"


def _display(plot: str, kind: str, severity: str, message: str) -> str:
    title = (f"list_aggregate(list_transform(string_split({kind}, '_'), "
             "lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')")
    emoji = " ".join(f"WHEN '{s}' THEN '{e}'" for s, e in C.SEVERITY_EMOJI.items())
    nl = "chr(10)"
    return (
        f"CASE {severity} {emoji} ELSE '{C.EMOJI_OTHER}' END || "
        f"' *कृषि सतर्कता | Agricultural Alert*' || {nl} || {nl} || '📍 Plot: ' || {plot} || {nl} || "
        f"'🔔 Type: ' || {title} || {nl} || '⚡ Severity: ' || upper({severity}) || {nl} || {nl} || "
        f"'📝 ' || {message} || {nl} || {nl} || "
        f"'💡 Recommendation: Take immediate action.' || {nl}"
    )


def _translated(message: str, language: str) -> str:
    phrase = " ".join(
        f"WHEN contains(lower({message}), '{w}') THEN '{key}'" for w, key in C.PHRASE_KEYWORDS)
    hits = " ".join(
        f"WHEN {language} = '{lang}' AND (CASE {phrase} END) = '{key}' THEN '{t}'"
        for lang, known in C.PHRASES.items() for key, t in known.items())
    return f"CASE WHEN {language} <> 'en' THEN CASE {hits} ELSE {message} END END"


CONTACTED = f"""{CONTACTS},
con AS (
  SELECT m.*, coalesce(c.phone, '') AS phone,
         coalesce(c.preferred_language, 'en') AS preferred_language,
         coalesce(c.preferred_channel, 'whatsapp') AS preferred_channel
  FROM msg m LEFT JOIN contacts c ON m.farmer_id = c.farmer_id)"""


def _routed(local: str) -> str:
    shown = _display("plot_id", "alert_type", "severity", "message_en")
    return f"""shown AS (
  SELECT *, {shown} || CASE WHEN coalesce(loc, '') <> '' THEN chr(10) || chr(10) || loc
                            ELSE '' END AS display,
         coalesce(nullif(channel, ''), preferred_channel, 'whatsapp') AS wanted
  FROM (SELECT *, {local} AS loc FROM con)),
routed AS (
  SELECT *, CASE WHEN wanted IN ('whatsapp', 'sms', 'voice_call') THEN wanted ELSE 'sns' END
              AS route,
         CASE WHEN wanted = 'sms' THEN 'Alert: ' || alert_type || '. ' || message_en[1:100]
              WHEN wanted <> 'voice_call' THEN display END AS body,
         CASE WHEN wanted NOT IN ('whatsapp', 'sms', 'voice_call')
              THEN 'Agri Alert: ' || alert_type END AS subject
  FROM shown)"""


OUTBOX = f"""{CONTACTED}, {_routed(_translated('message_en', 'preferred_language'))},
outbox AS (
  SELECT alert_id, route, phone, subject, body,
         CASE route WHEN 'whatsapp' THEN 'wa_' WHEN 'sms' THEN 'sms_'
              WHEN 'voice_call' THEN 'voice_' ELSE 'sns_' END
           || sha256(coalesce(body, alert_id)) AS message_id, ts
  FROM routed)"""
OUTBOX_BASE = f"{MSG_BASE}, {OUTBOX}"

FLAWED = """fl AS (
  SELECT * REPLACE (
    CASE WHEN k = 37 THEN ndvi + 10.0::DOUBLE ELSE ndvi END AS ndvi,
    CASE WHEN k = 38 THEN -moisture_pct ELSE moisture_pct END AS moisture_pct,
    CASE WHEN k >= 43 AND k < 46 AND severity IS NOT NULL THEN 'urgent' ELSE severity END
      AS severity,
    CASE WHEN k >= 2 THEN plot_id END AS plot_id)
  FROM ev)"""

SERVED = """served AS (
  SELECT alert_id, plot_id, alert_type, severity, message_en AS message, ts AS "timestamp",
         false AS acknowledged FROM msg)"""

# rule name -> condition under which a row of `fl` breaks it
RULES = {
    "required:event_uuid": "event_uuid IS NULL",
    "required:event_type": "event_type IS NULL",
    "required:ts": "ts IS NULL",
    "required:plot_id|crop":
        f"CASE WHEN event_type = '{C.MARKET}' THEN crop IS NULL ELSE plot_id IS NULL END",
}
_SCALED_READINGS = {
    "evi": _scaled(150, 4, 1000), "cloud_cover": "CAST(k % 41 AS DOUBLE) / 100",
    "wind_speed_kmh": _scaled(50, 2, 10), "rain_probability": _scaled(0, 1, 100),
    "battery_level": _scaled(600, 4, 10), "lon": _scaled(800, 1, 10),
    "price_per_quintal_inr": "price", "arrival_quantity_mt": _scaled(500, 45, 10),
    "price_change_pct": _scaled(-500, 10, 100),
}
RANGE_RULES = {
    f"range:{kind}.{r}":
        f"event_type = '{kind}' AND NOT ({_SCALED_READINGS.get(r, r)} BETWEEN "
        f"CAST({lo} AS DOUBLE) AND CAST({hi} AS DOUBLE))"
    for kind, ranges in C.RANGES.items() for r, (lo, hi) in ranges.items()
}
_MEMBER_COLUMNS = {"language": _list(C.LANGUAGES, "k % 8")}
MEMBER_RULES = {
    f"member:{kind}.{f}":
        f"event_type = '{kind}' AND {_MEMBER_COLUMNS.get(f, f)} NOT IN ("
        + ", ".join(f"'{v}'" for v in allowed) + ")"
    for kind, fields in C.MEMBERSHIP.items() for f, allowed in fields.items()
}
ALL_RULES = {**RULES, **RANGE_RULES, **MEMBER_RULES}


def _tally(rules: dict[str, str], extra: str = "") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS checked, "
        f"count(*) FILTER (WHERE {broken}) AS failed FROM fl"
        for name, broken in rules.items())
    return f"{BASE}, {FLAWED} SELECT *{extra} FROM ({rows})"


def _reasons(rules: dict[str, str]) -> str:
    return ("concat_ws(',', "
            + ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in rules.items())
            + ")")


def _ingest(kind: str) -> str:
    bad = "k IN (29, 30)"
    reasons = f"CASE WHEN {bad} THEN 'undecodable' ELSE {_reasons(ALL_RULES)} END"
    return f"""{BASE}, {FLAWED}
SELECT event_uuid AS record_id,
       CASE WHEN reasons = '' THEN 'accepted' ELSE 'quarantined' END AS outcome,
       CASE WHEN {bad} THEN 'agri.misc.raw' ELSE topic END AS topic,
       CASE WHEN NOT ({bad}) THEN coalesce(plot_id, CASE WHEN event_type = '{C.MARKET}' THEN crop
            END) END AS key,
       reasons
FROM (SELECT *, {reasons} AS reasons FROM fl WHERE event_type = '{kind}')"""


COUNTER = """cnt AS (SELECT {label} AS label, date_trunc('minute', ts) AS minute, count(*) AS n
  FROM ev WHERE {chosen} GROUP BY 1, 2),
counter AS (SELECT label, minute,
  CAST(sum(n) OVER (PARTITION BY label, CAST(minute AS DATE) ORDER BY minute) AS BIGINT) AS value
  FROM cnt),
grown AS (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN value < prev THEN value
  ELSE value - prev END AS increase
  FROM (SELECT *, lag(value) OVER (PARTITION BY label ORDER BY minute) AS prev FROM counter))"""

_SENT_TWICE = """twice AS (
  SELECT event_uuid, plot_id, event_type, ts, measure FROM ev
  UNION ALL
  SELECT event_uuid, plot_id, event_type, ts + INTERVAL 1 MINUTE, measure + 1 FROM ev)"""
_NEWEST_OF_TWICE = f"""{BASE}, {_SENT_TWICE}
SELECT event_uuid, plot_id, event_type, max(ts) AS ts, max_by(measure, ts) AS measure
FROM twice GROUP BY event_uuid, plot_id, event_type"""

_HEALTH = """(coalesce(g, 0) + coalesce(w, 0) + coalesce(c, 0)) /
  (CAST(g IS NOT NULL AS INT) + CAST(w IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT))"""


def _clamp(x: str, given: str) -> str:
    return (f"CASE WHEN {given} IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), "
            f"least(CAST(1 AS DOUBLE), {x})) END")


def _newest(value: str, kind: str) -> str:
    return (f"max_by({value}, struct_pack(t := ts, e := event_uuid)) "
            f"FILTER (WHERE event_type = '{kind}')")


def _drift() -> str:
    parts = []
    for name in ("ndvi", "humidity_pct", "moisture_pct"):
        kind = {"ndvi": C.SATELLITE, "humidity_pct": C.WEATHER, "moisture_pct": C.SOIL}[name]
        lo, hi = C.RANGES[kind][name]
        parts.append(
            f"SELECT '{name}' AS reading, ts >= TIMESTAMP '2024-01-16' AS after, {name} AS x, "
            f"greatest(0, least(9, floor(({name} - CAST({lo} AS DOUBLE)) * 10 / "
            f"(CAST({hi} AS DOUBLE) - CAST({lo} AS DOUBLE))))) AS bin FROM ev")
    rows = " UNION ALL ".join(parts)

    def whole(f: str) -> str:
        return f"FILTER (WHERE {f})"

    cols = []
    for t, cond in (("before", "NOT after"), ("after", "after")):
        n = f"CAST(count(x) {whole(cond)} AS DOUBLE)"
        s = f"sum(x) {whole(cond)}"
        ss = f"sum(x * x) {whole(cond)}"
        cols += [
            f"round({s} / {n}, 6) AS mean_{t}",
            f"round(sqrt(greatest({ss} / {n} - ({s} / {n}) * ({s} / {n}), 0)), 6) "
            f"AS stddev_{t}",
            f"round(1 - {n} / CAST(count(*) {whole(cond)} AS DOUBLE), 6) AS null_rate_{t}",
        ]
    return f"""{BASE}, items AS ({rows}),
bins AS (SELECT reading, bin, CAST(count(x) FILTER (WHERE after) AS DOUBLE) AS a,
         CAST(count(x) FILTER (WHERE NOT after) AS DOUBLE) AS b
         FROM items WHERE x IS NOT NULL GROUP BY 1, 2),
shares AS (SELECT reading, greatest(a / sum(a) OVER (PARTITION BY reading), 0.0001::DOUBLE) AS pa,
           greatest(b / sum(b) OVER (PARTITION BY reading), 0.0001::DOUBLE) AS pb FROM bins),
psi AS (SELECT reading, round(sum((pa - pb) * ln(pa / pb)), 6) AS psi FROM shares GROUP BY 1),
wide AS (SELECT reading, {', '.join(cols)} FROM items GROUP BY 1)
SELECT wide.*, psi.psi FROM wide JOIN psi USING (reading)"""


def _typed_drift(always: dict[str, list[str]]) -> str:
    """Rows per type, path and kind of value, out of the events the texts were made of."""
    number = "CAST(event_uuid AS BIGINT)"
    as_text, untyped = f"{number} % 50 = 0", f"{number} % 97 = 0 AND {number} % 50 <> 0"
    texts = {"report_type", "description", "language", "severity", "image_url", "market_location",
             "band_combination"}
    out = []

    def add(kind_of, path, kind, state, change, cond, least=1):
        of = f"'{kind_of}'" if kind_of else "CAST(NULL AS VARCHAR)"
        path, kind = (f"'{x}'" if x else "CAST(NULL AS VARCHAR)" for x in (path, kind))
        out.append(f"SELECT {of} AS event_type, {path} AS path, {kind} AS kind, count(*) AS n, "
                   f"'{state}' AS state, '{change}' AS change FROM ev WHERE {cond} "
                   f"HAVING count(*) >= {least}")

    add(None, None, "undecodable", "undecodable", "breaking", "k IN (29, 30)")
    add(None, None, "untyped", "untyped", "breaking", f"k NOT IN (29, 30) AND {untyped}")
    for kind_of, keys in C.DATA_KEYS.items():
        base = f"event_type = '{kind_of}' AND k NOT IN (29, 30) AND NOT ({untyped})"
        for key in keys:
            if key == "image_url":
                add(kind_of, key, "string", "known", "none", f"{base} AND k % 2 = 0")
            elif key == "humidity_pct":
                add(kind_of, key, "number", "known", "none", f"{base} AND NOT ({as_text})")
                add(kind_of, key, "string", "changed", "breaking", f"{base} AND {as_text}")
            elif key == "forecast_3d":
                add(kind_of, key, "object", "known", "none", base)
                for inner in ("temp_max", "rain_probability"):
                    add(kind_of, f"{key}.{inner}", "number", "known", "none", base)
            elif key in always[kind_of]:
                add(kind_of, key, "string" if key in texts else "number", "known", "none", base)
            else:
                add(kind_of, key, None, "missing", "breaking", "false", 0)
    add(C.SOIL, "firmware", "number", "unknown", "compatible",
        f"event_type = '{C.SOIL}' AND k < 10 AND NOT ({untyped})")
    return f"{BASE} " + " UNION ALL ".join(out)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    first_page = f"{BASE}, {SRC_ALL}, {HOURLY}"

    out["decode_events"] = f"""{BASE}
SELECT event_uuid, event_type, ts, plot_id,
       CASE WHEN event_type = '{C.MARKET}' THEN crop END AS crop, ndvi, temperature_c, temp_max,
       moisture_pct, description, price AS price_per_quintal_inr, soil_type, lat
FROM ev WHERE k NOT IN (29, 30)"""
    out["json_roundtrip"] = f"""{BASE}
SELECT event_uuid, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", plot_id, crop,
       ndvi, temperature_c, moisture_pct, price AS price_per_quintal_inr FROM ev"""
    out["json_array_roundtrip"] = out["json_roundtrip"]
    out["topic_route"] = f"""{BASE}
SELECT topic, coalesce(plot_id, crop) AS key,
       '{{"event_uuid":"' || event_uuid || '","event_type":"' || event_type || '","ts":"'
         || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"'
         || coalesce(',"plot_id":"' || plot_id || '"', '')
         || coalesce(',"crop":"' || crop || '"', '') || '}}' AS value,
       event_uuid[1:8] AS short_id FROM ev"""
    out["lake_curated"] = f"""{BASE}
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS n,
       min(ts) AS first_ts, max(ts) AS last_ts, max(ndvi) AS max_ndvi, max(temperature_c) AS max_temp
FROM ev GROUP BY 1, 2"""
    out["union_streams"] = f"""{BASE}
SELECT event_uuid, event_type, ts, plot_id, temperature_c, humidity_pct, ndvi, moisture_pct
FROM ev WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}')"""
    out["unknown_plot_key"] = f"""{BASE}, {FLAWED}
SELECT coalesce(plot_id, 'unknown') AS plot_id, event_type, count(*) AS n_events FROM fl
WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}') GROUP BY 1, 2"""
    out["dedup_events"] = _NEWEST_OF_TWICE
    out["stream_upsert"] = _NEWEST_OF_TWICE
    out["stream_dedup"] = f"""{BASE}
SELECT event_uuid, plot_id, event_type, ts, measure FROM ev"""
    out["upsert_latest"] = f"""{BASE},
both_sides AS (
  SELECT event_uuid, plot_id, event_type, ts, measure FROM ev
  UNION ALL
  SELECT event_uuid, plot_id, event_type,
         CASE WHEN event_type = '{C.MARKET}' THEN ts + INTERVAL 1 HOUR
              ELSE ts - INTERVAL 1 HOUR END, measure + 1 FROM ev)
SELECT event_uuid, plot_id, event_type, ts, measure FROM both_sides
QUALIFY row_number() OVER (PARTITION BY event_uuid, plot_id ORDER BY ts DESC) = 1"""
    out["idempotent_insert"] = f"""{BASE}, {_SENT_TWICE}
SELECT event_uuid, plot_id, event_type, ts, measure FROM twice t
WHERE NOT EXISTS (SELECT 1 FROM ev s WHERE s.ts < TIMESTAMP '2024-01-16'
                  AND s.event_uuid = t.event_uuid AND s.plot_id IS NOT DISTINCT FROM t.plot_id)
QUALIFY row_number() OVER (PARTITION BY event_uuid, plot_id ORDER BY ts DESC) = 1"""
    out["stored_upsert"] = out["upsert_latest"]
    out["stored_insert"] = f"""{BASE}
SELECT event_uuid, plot_id, event_type, ts, measure FROM ev WHERE ts >= TIMESTAMP '2024-01-16'"""
    out["events_sorted"] = f"""{BASE}
SELECT event_uuid, event_type, ts, plot_id, crop FROM ev ORDER BY ts, event_uuid"""
    out["per_plot_order"] = f"{BASE} SELECT plot_id, ts, event_uuid, event_type FROM ev"
    out["event_counts"] = f"{BASE} SELECT event_type, count(*) AS n_events FROM ev GROUP BY 1"
    out["round_readings"] = f"""{BASE}
SELECT event_uuid, CASE WHEN ndvi IS NOT NULL THEN {_scaled(201, 6, 1000)} END AS ndvi,
       humidity_pct, precipitation_mm, ph FROM ev"""
    out["plot_id_parse"] = f"""
WITH named AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         {_list(C.STATES, 'user_id % 10')} || '_' || CAST(user_id % 900 + 100 AS VARCHAR) || '_'
           || CAST(user_id % 500 + 1 AS VARCHAR) AS name FROM events),
p AS (SELECT event_id, CASE WHEN k = 41 THEN lower(name) WHEN k = 42 THEN 'plot' ELSE name END
             AS plot_id FROM named)
SELECT event_id, plot_id, string_split(plot_id, '_')[1] AS state_code,
       TRY_CAST(string_split(plot_id, '_')[2] AS INT) AS block_no,
       TRY_CAST(string_split(plot_id, '_')[3] AS INT) AS field_no,
       regexp_matches(plot_id, '{C.PLOT_ID_PATTERN}') AS well_formed,
       string_split(plot_id, '_')[1] IN ({", ".join(f"'{s}'" for s in C.STATES)}) AS known_state
FROM p"""
    out["report_features"] = f"""{BASE}
SELECT event_uuid, plot_id, report_type, severity, {_list(C.PESTS, 'k % 5')} AS pest, crop,
       k % 2 = 0 AS has_image, CASE WHEN k % 2 = 0 THEN plot_id END AS image_plot,
       CASE WHEN k % 2 = 0 THEN event_uuid END AS image_file,
       lat BETWEEN 20 AND 30 AS inside_region
FROM ev WHERE event_type = '{C.REPORT}'"""

    hourly = f"""{first_page}
SELECT plot_id, window_start, window_end, n_ndvi, n_moisture, n_temp, avg_ndvi, avg_moisture,
       avg_temp FROM hm"""
    out["hourly_plot_metrics"] = hourly
    out["salted_metrics"] = hourly
    out["hot_salted_metrics"] = hourly
    out["stream_closed_hours"] = hourly
    out["stream_admission"] = """
SELECT count(*) AS input_rows, true AS bytes_within_bound, true AS listener_agrees FROM events"""
    for key in ("plot_alerts", "stream_alerts", "stream_alert_sink"):
        out[key] = f"{ALERT_BASE} SELECT * FROM alerts"
    out["heat_air_only"] = f"""{BASE},
src AS (SELECT * FROM ev WHERE event_type = '{C.WEATHER}'), {ALERTS}
SELECT * FROM alerts WHERE alert_type = 'heat_stress'"""

    out["alert_message_shape"] = f"{MSG_BASE} SELECT * FROM msg"
    out["alert_contact"] = f"""{MSG_BASE}, {CONTACTED}
SELECT alert_id, farmer_id, phone, preferred_language, preferred_channel FROM con"""
    out["format_alert"] = f"""{MSG_BASE}
SELECT alert_id, {_display('plot_id', 'alert_type', 'severity', 'message_en')} AS display FROM msg"""
    out["translate_alerts"] = f"""{MSG_BASE}, {CONTACTS},
words AS (
  SELECT farmer_id, message_en FROM msg
  UNION ALL
  SELECT plot_id, 'Weather update: rain chance ' || CAST(k AS VARCHAR) || '%' FROM ev
  WHERE event_type = '{C.WEATHER}'
  UNION ALL
  SELECT plot_id, report_type || ': ' || description FROM ev WHERE event_type = '{C.REPORT}')
SELECT w.farmer_id, message_en, coalesce(preferred_language, 'en') AS preferred_language,
       {_translated('message_en', "coalesce(preferred_language, 'en')")} AS message_local
FROM words w LEFT JOIN contacts c ON w.farmer_id = c.farmer_id"""
    out["channel_route"] = f"""{MSG_BASE}, {CONTACTED}, {_routed('CAST(NULL AS VARCHAR)')}
SELECT alert_id, channel, preferred_channel, route, subject, body FROM routed"""
    out["notify_outbox"] = f"{OUTBOX_BASE} SELECT * FROM outbox"
    out["bulk_send_summary"] = f"""{OUTBOX_BASE}
SELECT route AS channel, count(*) FILTER (WHERE alert_id[1] NOT IN ('0', '1')) AS succeeded,
       count(*) AS total FROM outbox GROUP BY 1"""
    out["dlq_records"] = f"""{OUTBOX_BASE}
SELECT 'delivery' AS kind, alert_id AS ref, 'provider timeout' AS error, 1 AS attempts,
       ts + INTERVAL 1 MINUTE AS ts, CAST(NULL AS VARCHAR) AS bad_record, route, phone, subject, body
FROM outbox WHERE alert_id[1] IN ('0', '1')
UNION ALL
SELECT 'record', event_uuid, 'undecodable', 0, ts, CASE k WHEN 29 THEN 'not json' ELSE '{{bad' END,
       NULL, NULL, NULL, NULL
FROM ev WHERE k IN (29, 30)"""
    out["dlq_retry"] = f"""{OUTBOX_BASE}
SELECT alert_id, alert_id[1] = '1' AS recovered, 2 AS attempts
FROM outbox WHERE alert_id[1] IN ('0', '1')"""
    out["dlq_retry_tally"] = f"""{OUTBOX_BASE}
SELECT count(*) FILTER (WHERE alert_id[1] = '1') AS recovered,
       count(*) FILTER (WHERE alert_id[1] = '0') AS still_failing FROM outbox"""

    newest = "row_number() OVER (PARTITION BY plot_id ORDER BY ts DESC, event_uuid DESC) = 1"
    out["latest_weather"] = f"""{BASE}
SELECT plot_id, ts, temperature_c, humidity_pct, precipitation_mm,
       'Max ' || CAST((250 + k) // 10 AS VARCHAR) || '.' || CAST((250 + k) % 10 AS VARCHAR)
         || '°C, ' || CAST(k AS VARCHAR) || '% chance of rain' AS forecast_3d
FROM ev WHERE event_type = '{C.WEATHER}' QUALIFY {newest}"""
    out["latest_soil"] = f"""{BASE}
SELECT plot_id, ts, moisture_pct, ph, nitrogen_ppm, phosphorus_ppm, potassium_ppm,
       CASE WHEN good >= 5 THEN 'good' WHEN good >= 3 THEN 'fair' ELSE 'poor' END AS health_rating
FROM (SELECT *, CAST(moisture_pct >= 25 AS INT) + CAST(ph BETWEEN 6.0 AND 7.5 AS INT)
        + CAST(nitrogen_ppm >= 240 AS INT) + CAST(phosphorus_ppm >= 20 AS INT)
        + CAST(potassium_ppm >= 180 AS INT) AS good
      FROM ev WHERE event_type = '{C.SOIL}') QUALIFY {newest}"""
    advice = " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in C.RECOMMENDATIONS.items())
    out["plot_status"] = f"""{ALERT_BASE}, {PLOTS},
r AS (SELECT plot_id, max(ts) AS last_updated, {_newest('ndvi', C.SATELLITE)} AS ndvi,
             {_newest('moisture_pct', C.SOIL)} AS moisture,
             {_newest('temperature_c', C.WEATHER)} AS temp
      FROM ev WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}') GROUP BY 1),
h AS (SELECT *, {_clamp('(ndvi - 0.2::DOUBLE) / 0.6::DOUBLE', 'ndvi')} AS g,
             {_clamp('(moisture - 20) / 40', 'moisture')} AS w,
             {_clamp('(40 - temp) / 20', 'temp')} AS c FROM r),
al AS (SELECT plot_id, string_agg(item, ',' ORDER BY item) AS alerts FROM (
         SELECT plot_id, strftime(window_end, '%Y-%m-%d %H:%M:%S') || ' ' || alert_type || ' '
                || severity AS item FROM alerts) GROUP BY 1),
adv AS (SELECT plot_id, string_agg(rec, ',' ORDER BY rec) AS recommendations FROM (
          SELECT DISTINCT plot_id, CASE alert_type {advice} END AS rec FROM alerts) GROUP BY 1)
SELECT p.plot_id, p.crop_type, {_HEALTH} AS health_score, last_updated,
       coalesce(alerts, '') AS alerts, coalesce(recommendations, '') AS recommendations
FROM plots p JOIN h ON p.plot_id = h.plot_id LEFT JOIN al ON p.plot_id = al.plot_id
LEFT JOIN adv ON p.plot_id = adv.plot_id"""
    out["plot_lookup"] = f"""{ALERT_BASE}, {PLOTS}
SELECT * FROM plots WHERE plot_id = (
  SELECT plot_id FROM alerts GROUP BY plot_id ORDER BY count(*) DESC, plot_id DESC LIMIT 1)"""
    out["recent_alerts"] = f"""{MSG_BASE}, {SERVED}
SELECT * FROM served ORDER BY "timestamp" DESC, alert_id LIMIT 10"""
    out["recent_alerts_of_plot"] = f"""{MSG_BASE}, {SERVED}
SELECT * FROM served WHERE plot_id = (
  SELECT plot_id FROM served GROUP BY 1 ORDER BY count(*) DESC, plot_id DESC LIMIT 1)
ORDER BY "timestamp" DESC, alert_id LIMIT 5"""
    out["recent_alerts_per_plot"] = f"""{MSG_BASE}, {SERVED}
SELECT * FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY plot_id ORDER BY "timestamp" DESC, alert_id) AS INT) AS recency FROM served)
WHERE recency <= 3"""
    out["ack_alerts"] = f"""{MSG_BASE}, {SERVED}
SELECT * REPLACE (severity = 'medium' AS acknowledged) FROM served"""
    out["plots_with_open_alerts"] = f"""{MSG_BASE}
SELECT * FROM plots WHERE plot_id IN (SELECT plot_id FROM msg WHERE severity <> 'medium')"""
    words = "'Weather update: rain chance ' || CAST(k AS VARCHAR) || '%'"
    out["create_alerts"] = f"""{BASE}
SELECT {_alert_id('plot_id', "'weather_alert'", 'ts', words)} AS alert_id,
       'alert_' || plot_id || '_' || CAST(length({words}) AS VARCHAR) AS legacy_id, plot_id,
       'weather_alert' AS alert_type,
       CASE WHEN k >= 80 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS severity,
       {words} AS message, ts AS "timestamp", false AS acknowledged
FROM ev WHERE event_type = '{C.WEATHER}'"""
    out["manual_reports"] = f"""{BASE}
SELECT {_alert_id('plot_id', 'report_type', 'ts', 'description')} AS alert_id,
       'manual_' || plot_id || '_' || CAST(length(description) AS VARCHAR) AS legacy_id, plot_id,
       report_type AS alert_type, severity, description AS message, ts AS "timestamp",
       false AS acknowledged
FROM ev WHERE event_type = '{C.REPORT}'"""

    out["alerts_appended"] = f"{out['create_alerts']} UNION ALL ({out['manual_reports']})"
    out["dq_health_score"] = f"""WITH status AS ({out["plot_status"]})
SELECT 'range:health_score' AS rule, count(*) AS checked,
       count(*) FILTER (WHERE health_score NOT BETWEEN 0 AND 1) AS failed FROM status"""
    out["dq_ranges"] = _tally(RANGE_RULES)
    out["dq_membership"] = _tally(MEMBER_RULES)
    out["dq_summary"] = _tally(ALL_RULES, ", failed = 0 AS passed")
    out["dq_uniqueness"] = f"""{BASE},
sent AS (SELECT event_uuid FROM ev UNION ALL
         SELECT event_uuid FROM ev WHERE CAST(event_uuid AS BIGINT) % 10 = 0)
SELECT event_uuid, count(*) AS copies FROM sent GROUP BY 1 HAVING count(*) > 1"""
    out["dq_quarantine"] = f"""{BASE}, {FLAWED}
SELECT event_uuid, CASE WHEN reasons = '' THEN 'accepted' ELSE 'quarantined' END AS outcome,
       reasons FROM (SELECT event_uuid, {_reasons(ALL_RULES)} AS reasons FROM fl)"""
    # keys that are never null appear as often as their events; band and resolution never
    per_key = []
    always = {
        C.SATELLITE: ["ndvi", "evi", "cloud_cover"],
        C.WEATHER: C.DATA_KEYS[C.WEATHER], C.SOIL: C.DATA_KEYS[C.SOIL],
        C.REPORT: ["report_type", "description", "language", "severity"],
        C.MARKET: C.DATA_KEYS[C.MARKET],
    }
    for kind, keys in C.DATA_KEYS.items():
        for key in keys:
            cond = f"event_type = '{kind}' AND k NOT IN (29, 30)"
            if key == "image_url":
                cond += " AND k % 2 = 0"
            elif key not in always[kind]:
                cond += " AND false"
            per_key.append(
                f"SELECT '{kind}' AS event_type, '{key}' AS data_key, count(*) FILTER "
                f"(WHERE {cond}) AS n, CASE WHEN count(*) FILTER (WHERE {cond}) = 0 THEN 'missing' "
                f"ELSE 'known' END AS state FROM ev")
    per_key.append(
        f"SELECT '{C.SOIL}', 'firmware', count(*), 'unknown' FROM ev "
        f"WHERE event_type = '{C.SOIL}' AND k < 10")
    out["contract_drift"] = f"{BASE} " + " UNION ALL ".join(per_key)
    out["contract_typed_drift"] = _typed_drift(always)
    out["ingest_run_metrics"] = f"""{BASE}
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_day, count(*) AS records,
       count(DISTINCT coalesce(plot_id, crop)) AS sources, count(*) >= 20 AS enough
FROM ev GROUP BY 1, 2"""
    out["cadence_gaps"] = f"""{BASE}, {PLOTS},
days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30',
                INTERVAL 1 DAY)) AS DATE) AS day),
seen AS (SELECT plot_id, CAST(ts AS DATE) AS day,
                count(*) FILTER (WHERE event_type = '{C.WEATHER}') AS w,
                count(*) FILTER (WHERE event_type = '{C.SOIL}') AS s,
                count(*) FILTER (WHERE event_type = '{C.SATELLITE}') AS g FROM ev GROUP BY 1, 2),
spine AS (SELECT p.plot_id, d.day, coalesce(w, 0) AS w, coalesce(s, 0) AS s,
                 coalesce(g, 0) AS g FROM plots p CROSS JOIN days d
          LEFT JOIN seen x ON x.plot_id = p.plot_id AND x.day = d.day),
rolled AS (SELECT *, CAST(sum(g) OVER b AS BIGINT) AS passes, count(*) OVER b AS back FROM spine
           WINDOW b AS (PARTITION BY plot_id ORDER BY day
                        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
gaps AS (
  SELECT plot_id AS source, day, '{C.WEATHER}' AS reading, 4 AS expected, w AS seen FROM rolled
  UNION ALL SELECT plot_id, day, '{C.SOIL}', 7, s FROM rolled
  UNION ALL SELECT plot_id, day, '{C.SATELLITE}', CASE WHEN back = 3 THEN 1 ELSE 0 END, passes
  FROM rolled
  UNION ALL SELECT c.crop, d.day, '{C.MARKET}', 1, coalesce(x.n, 0)
  FROM (SELECT unnest([{", ".join(f"'{c}'" for c in C.CROPS)}]) AS crop) c CROSS JOIN days d
  LEFT JOIN (SELECT crop, CAST(ts AS DATE) AS day, count(*) AS n FROM ev
             WHERE event_type = '{C.MARKET}' GROUP BY 1, 2) x
    ON x.crop = c.crop AND x.day = d.day),
islands AS (
  SELECT *, CASE WHEN seen > 0 THEN day ELSE day - CAST(row_number() OVER (
    PARTITION BY source, reading, seen = 0 ORDER BY day) AS INT) END AS island
  FROM gaps WHERE expected > seen)
SELECT source, reading,
       CAST(min(day) - CASE WHEN reading = '{C.SATELLITE}' THEN 2 ELSE 0 END AS VARCHAR) AS first_day,
       CAST(max(day) AS VARCHAR) AS last_day, CAST(sum(expected) AS BIGINT) AS expected,
       CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(expected - seen) AS BIGINT) AS missing
FROM islands GROUP BY source, reading, seen > 0, island"""
    out["ingest_weather"] = _ingest(C.WEATHER)
    out["ingest_satellite"] = _ingest(C.SATELLITE)
    out["ingest_market"] = _ingest(C.MARKET)

    out["windowed_join"] = f"""{BASE}, {PLOTS},
w AS (SELECT plot_id, date_trunc('hour', ts) AS hour, {_mean('temperature_c')} AS air_temp,
             {_mean('precipitation_mm')} AS rain FROM ev WHERE event_type = '{C.WEATHER}'
      GROUP BY 1, 2),
g AS (SELECT plot_id, date_trunc('hour', ts) AS hour, {_mean('ndvi')} AS ndvi FROM ev
      WHERE event_type = '{C.SATELLITE}' GROUP BY 1, 2),
m AS (SELECT crop, CAST(ts AS DATE) AS day, {_mean('price')} AS price FROM ev
      WHERE event_type = '{C.MARKET}' GROUP BY 1, 2),
wg AS (SELECT coalesce(w.plot_id, g.plot_id) AS plot_id, coalesce(w.hour, g.hour) AS hour,
              air_temp, rain, ndvi
       FROM w FULL JOIN g ON w.plot_id = g.plot_id AND w.hour = g.hour)
SELECT wg.plot_id, coalesce(p.crop_type, m.crop) AS crop_type,
       CAST(coalesce(CAST(hour AS DATE), m.day) AS VARCHAR) AS day, hour, air_temp, rain, ndvi, price
FROM (wg LEFT JOIN plots p ON wg.plot_id = p.plot_id)
FULL JOIN m ON m.crop = p.crop_type AND m.day = CAST(hour AS DATE)"""
    out["asof_weather"] = f"""{BASE},
g AS (SELECT event_uuid, plot_id, ts, ndvi FROM ev WHERE event_type = '{C.SATELLITE}'),
w AS (SELECT plot_id, ts AS weather_ts, max_by(temperature_c, event_uuid) AS temperature_c
      FROM ev WHERE event_type = '{C.WEATHER}' GROUP BY 1, 2)
SELECT g.*, w.weather_ts, w.temperature_c
FROM g ASOF LEFT JOIN w ON g.plot_id = w.plot_id AND g.ts >= w.weather_ts"""
    out["price_change"] = f"""{BASE}
SELECT event_uuid, crop, market_location, ts, price, prev AS previous_price,
       CASE WHEN prev <> 0 THEN (price - prev) / prev * 100 END AS change_pct
FROM (SELECT *, lag(price) OVER (PARTITION BY crop, market_location ORDER BY ts, event_uuid) AS prev
      FROM ev WHERE event_type = '{C.MARKET}')"""
    out["plot_market_price"] = f"""{BASE}, {PLOTS},
m AS (SELECT crop, price, market_location, ts AS price_ts FROM ev
      WHERE event_type = '{C.MARKET}'
      QUALIFY row_number() OVER (PARTITION BY crop ORDER BY ts DESC, event_uuid DESC) = 1)
SELECT plot_id, crop_type, price, market_location, price_ts
FROM plots LEFT JOIN m ON m.crop = plots.crop_type"""
    air = f"CASE WHEN event_type = '{C.WEATHER}' THEN temperature_c END"
    three = ", ".join(
        f"{_mean(x)} AS avg_{n}, min({x}) AS min_{n}, max({x}) AS max_{n}"
        for n, x in (("ndvi", "ndvi"), ("moisture", "moisture_pct"), ("air_temp", "air")))
    out["plot_daily_features"] = f"""{BASE}
SELECT plot_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {three},
       {_double(f"sum({_units('precipitation_mm')})")} AS rain_mm,
       count(*) AS n_readings
FROM (SELECT *, {air} AS air FROM ev
      WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}'))
GROUP BY 1, 2"""
    out["rolling_24h"] = f"""{BASE},
s AS (SELECT plot_id, date_trunc('second', ts) AS ts, sum({_units('temperature_c')}) AS total,
             count(temperature_c) AS n FROM ev WHERE event_type = '{C.WEATHER}' GROUP BY 1, 2)
SELECT plot_id, ts, CASE WHEN sum(n) OVER b > 0 THEN {_double("sum(total) OVER b")} / CAST(sum(n) OVER b AS DOUBLE) END
         AS rolling_mean, CAST(sum(n) OVER b AS BIGINT) AS n_readings
FROM s WINDOW b AS (PARTITION BY plot_id ORDER BY ts
                    RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)"""

    out["ingest_rate"] = f"""{BASE}, {COUNTER.format(label='topic', chosen='true')}
SELECT label AS topic, minute, CAST(increase AS DOUBLE) / 60 AS per_second FROM grown"""
    bounds = [5, 10, 25, 50, 100, 250, 500]
    counts = ", ".join(f"count(*) FILTER (WHERE measure <= {b}) AS b{b}" for b in bounds)
    steps, low, below = [], "0", "0"
    for b in bounds:
        steps.append(
            f"WHEN b{b} >= 0.95::DOUBLE * total THEN {low}::DOUBLE + ({b} - {low})::DOUBLE * "
            f"((0.95::DOUBLE * total - {below}) / (b{b} - {below}))")
        low, below = str(b), f"b{b}"
    out["hist_p95"] = f"""{BASE},
h AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, {counts}, count(measure) AS total
      FROM ev GROUP BY 1)
SELECT window_start, CASE {' '.join(steps)} ELSE 500::DOUBLE END AS quantile FROM h WHERE total > 0"""
    counter = COUNTER.format(label="channel", chosen=f"event_type = '{C.REPORT}'")
    out["alerts_sent_hourly"] = f"""{BASE}, {counter}
SELECT date_trunc('hour', minute) AS hour, CAST(coalesce(sum(increase), 0) AS BIGINT) AS sent
FROM grown GROUP BY 1"""
    counter = COUNTER.format(label="1", chosen=f"event_type = '{C.SOIL}'")
    out["dlq_alarm"] = f"""{BASE}, {counter}
SELECT time_bucket(INTERVAL 5 MINUTE, minute) AS window_start, {_mean('value')} AS mean_value,
       {_mean('value')} > 50 AS alarm FROM counter GROUP BY 1"""
    out["dlq_arrivals_alarm"] = f"""{BASE}
SELECT date_trunc('hour', ts) AS window_start, count(*) AS letters, count(*) > 5 AS alarm
FROM ev WHERE event_type = '{C.SOIL}' GROUP BY 1"""
    out["consumer_lag"] = f"""{BASE},
m AS (SELECT topic, CAST(CAST(event_uuid AS BIGINT) % 3 AS INT) AS "partition",
             date_trunc('minute', ts) AS minute, count(*) AS n,
             count(*) FILTER (WHERE k >= 33) AS c FROM ev GROUP BY 1, 2, 3),
l AS (SELECT topic, "partition", minute,
             CAST(sum(n - c) OVER (PARTITION BY topic, "partition" ORDER BY minute) AS BIGINT)
               AS lag FROM m),
g AS (SELECT *, lag - lag(lag) OVER (PARTITION BY topic, "partition" ORDER BY minute) AS growth
      FROM l)
SELECT *, lag > 100 OR coalesce(growth, 0) > 50 AS alarm FROM g"""
    out["latency_p95"] = f"""{BASE}
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       round(quantile_cont(measure, 0.95), 6) AS p95, count(*) AS n_requests,
       quantile_cont(measure, 0.95) > 150 AS alarm FROM ev GROUP BY 1, 2"""
    out["latency_sketches"] = f"{BASE} " + " UNION ALL ".join(
        f"SELECT '{span}' AS span, event_type, {start} AS start, count(measure) AS n, true AS within "
        f"FROM ev WHERE measure IS NOT NULL GROUP BY 2, 3" for span, start in (
            ("5 minutes", "time_bucket(INTERVAL 5 MINUTE, ts)"), ("1 hour", "date_trunc('hour', ts)"),
            ("1 day", "CAST(date_trunc('day', ts) AS TIMESTAMP)")))
    out["run_success_rate"] = f"""{BASE},
runs AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) % 2 = 0 AS success FROM ev
         GROUP BY 1, 2)
SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE success) AS succeeded,
       CAST(count(*) FILTER (WHERE success) AS DOUBLE) / count(*) AS rate FROM runs GROUP BY 1"""
    out["data_drift"] = _drift()
    out["knn_topk"] = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id,
             list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score
      FROM q CROSS JOIN embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)
               AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""

    out["stream_bronze"] = f"""{BASE}
SELECT event_uuid AS record_id, topic, coalesce(plot_id, crop) AS key, ts AS received FROM ev"""
    out["fanout_split"] = f"""{BASE}
SELECT 'dashboard' AS consumer, event_uuid FROM ev
UNION ALL SELECT 'alerting', event_uuid FROM ev WHERE severity IN ('high', 'critical')
UNION ALL SELECT 'training', event_uuid FROM ev
WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}')"""
    out["stream_interval_join"] = f"""{BASE}
SELECT g.event_uuid AS pass_id, g.plot_id, g.ts AS pass_ts, g.ndvi, w.event_uuid AS weather_id,
       w.ts AS weather_ts, w.temperature_c
FROM ev g LEFT JOIN ev w ON g.plot_id = w.plot_id AND w.ts <= g.ts
  AND w.ts >= g.ts - INTERVAL 6 HOUR AND w.event_type = '{C.WEATHER}'
WHERE g.event_type = '{C.SATELLITE}'"""
    out["stream_engine_join"] = out["stream_interval_join"]
    out["late_events"] = f"""{BASE},
a AS (SELECT event_uuid, plot_id, ts, CAST(date_diff('day', DATE '2024-01-01',
             CAST(ts + to_hours(k) AS DATE)) // 10 AS INT) AS instalment FROM ev),
m AS (SELECT plot_id, instalment, max(ts) AS newest FROM a GROUP BY 1, 2)
SELECT a.*, coalesce(a.ts < (SELECT max(newest) FROM m WHERE m.plot_id = a.plot_id
                             AND m.instalment < a.instalment) - INTERVAL 1 HOUR, false) AS late
FROM a"""
    last = ", ".join(
        f"max_by({r}, struct_pack(t := ts, e := event_uuid)) FILTER (WHERE {r} IS NOT NULL) "
        f"AS last_{r}" for r in ("ndvi", "moisture_pct", "temperature_c"))
    out["stream_last_reading"] = f"""{BASE}
SELECT plot_id, {last}, max(ts) AS last_ts FROM ev
WHERE event_type IN ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}') GROUP BY 1"""
    return out
