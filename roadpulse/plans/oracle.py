"""The registered queries in plain SQL, for a second engine to check results against."""

from __future__ import annotations

import math

ORACLE: dict[str, str] = {}

# Fixed values of the viewer and the weather service, stated here once more so that a wrong value in the package shows.
_ICON_BY_LEVEL = {
    1: "./static/imgs/normal_traffic_logo_resized.png",
    2: "./static/imgs/moderate_traffic_resized.png",
    3: "./static/imgs/high_traffic_resized.png",
    4: "./static/imgs/extreme_traffic_resized.png",
}
_ICON_DEFAULT = "./static/imgs/transparent_logo_resized.png"
_COLOUR_NAMES = {1: "color-normal-traffic", 2: "color-moderate-traffic", 3: "color-high-traffic", 4: "color-extreme-traffic"}
_COLOUR_RGB = {1: (99, 214, 104), 2: (240, 125, 2), 3: (230, 0, 0), 4: (158, 19, 19)}
_ZONE_NAMES = {
    "it": {
        1: "Bolzano, Oltradige e Bassa Atesina",
        2: "Burgraviato - Merano e dintorni",
        3: "Val Venosta",
        4: "Val d'Isarco e Val Sarentino",
        5: "Alta Val d'Isarco - Vipiteno e dintorni",
        6: "Val Pusteria",
        7: "Ladinia - Dolomiti",
    },
    "de": {
        1: "Bozen, Überetsch und Unterland",
        2: "Burggrafenamt - Meran und Umgebung",
        3: "Vinschgau",
        4: "Eisacktal und Sarntal",
        5: "Wipptal - Sterzing und Umgebung",
        6: "Pustertal",
        7: "Ladinia - Dolomiten",
    },
}
_ZONE_UNKNOWN = "Invalid Weather Station Index. It must be within [1-7]."
_ENTITIES = [("amp", "&"), ("apos", "'"), ("#x27", "'"), ("#x2F", "/"), ("#39", "'"), ("#47", "/"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("quot", '"')]
_BOX = (
    ' <p style="font-size:20px"> <b> Location: </b>  {abitato_sito_i} / {abitato_sito_d}<br> <b> Street name:  </b> '
    "{fw_name_custom_i} / {fw_name_custom_d} <br>  <b> Closest Weather station: </b> {name_i} / {name_d} <br>  "
    "<b>Direction 1: </b> From: {descrizione_i_2} / {descrizione_d_2} To: {descrizione_i_1} / {descrizione_d_1} <br> "
    "<b>Direction 2: </b> From: {descrizione_i_1} / {descrizione_d_1} To: {descrizione_i_2} / {descrizione_d_2} <br> "
    "<center><a href=./heatmap?station_id={station_index}> View Traffic Heatmap </a> </p> </center>"
)
# Means of the order statistics of twelve standard normal draws.
_ORDER_MEANS = [-1.635, -1.1139, -0.7916, -0.5362, -0.3119, -0.1025, 0.1025, 0.3119, 0.5362, 0.7916, 1.1139, 1.635]

_CLIMATE = """
    cast(sum(cast(round({v} * 100) as bigint)) as double) / (count({v}) * 100.0) as temperature,
    cast(sum(cast(round({v} * 100) as bigint)) as double) / 10000.0 as niederschlag"""

_CTES: dict[str, str] = {
    "counted": f"""
  select cast(2 + user_id // 10 as integer) as station_id, date_trunc('hour', ts) as ts,
    cast(count(case when event_id % 2 = 0 then 1 end) as integer) as count_1,
    cast(count(case when event_id % 2 = 1 then 1 end) as integer) as count_2,
    {_CLIMATE.format(v="(case when event_type <> 'signup' then value end)")}
  from events group by 1, 2""",
    "peaks": "select station_id, max(count_1) as peak_1, max(count_2) as peak_2 from counted group by 1",
    "panel": """
  select station_id, ts, count_1, count_2, temperature, niederschlag,
    cast(1 + least(3, (count_1 * 4) // (peak_1 + 1)) as integer) as traffic_1,
    cast(1 + least(3, (count_2 * 4) // (peak_2 + 1)) as integer) as traffic_2,
    cast(hour(ts) as integer) as hour, cast(isodow(ts) - 1 as integer) as week_day,
    cast(station_id * 10000000 + date_diff('day', date '1970-01-01', cast(ts as date)) * 24 + hour(ts) as bigint) as obs_id
  from counted join peaks using (station_id)""",
    "sided_peaks": """
  select station_id, ts >= timestamp '2024-01-25 00:00:00' as later, max(count_1) as peak_1, max(count_2) as peak_2
  from counted group by 1, 2""",
    "facts": """
  select station_id, ts, count_1, count_2, temperature, niederschlag, later,
    cast(1 + least(3, (count_1 * 4) // (peak_1 + 1)) as integer) as traffic_1,
    cast(1 + least(3, (count_2 * 4) // (peak_2 + 1)) as integer) as traffic_2, cast(hour(ts) as integer) as hour,
    cast(station_id * 10000000 + date_diff('day', date '1970-01-01', cast(ts as date)) * 24 + hour(ts) as bigint) as obs_id
  from (select *, ts >= timestamp '2024-01-25 00:00:00' as later from counted) join sided_peaks using (station_id, later)""",
    "stations": """
  select cast(s_suppkey + 2 as integer) as station_id, cast(1 + s_nationkey % 8 as integer) as weather_index,
    46.0 + (s_suppkey % 100) / 128.0 as latitude, 10.0 + (s_suppkey % 64) / 32.0 as longitude,
    s_name || ' I' as abitato_sito_i, s_name || ' D' as abitato_sito_d,
    'Via ' || n_name as fw_name_custom_i, 'Straße ' || n_name as fw_name_custom_d,
    n_name || ' nord' as descrizione_i_1, n_name || ' Nord' as descrizione_d_1,
    n_name || ' sud' as descrizione_i_2, n_name || ' Süd' as descrizione_d_2,
    'Stazione ' || s_nationkey as name_i, 'Station ' || s_nationkey as name_d,
    cast(row_number() over (order by s_suppkey) - 1 as bigint) as station_index
  from supplier join nation on s_nationkey = n_nationkey""",
    "daily": """
  select cast(1 + user_id % 7 as integer) as weather_index, cast(ts as date) as day,
    floor(max(value) / 10) as temperature_max, floor(min(value) / 10) as temperature_min,
    cast(count(case when event_type = 'error' then 1 end) % 4 as double) as rain_from,
    cast(count(case when event_type = 'error' then 1 end) % 4 + count(case when event_type = 'click' then 1 end) % 5 as double) as rain_to,
    cast(count(case when hour(ts) between 0 and 6 then 1 end) % 4 as double) as s1,
    cast(count(case when hour(ts) between 7 and 12 then 1 end) % 4 as double) as s2,
    cast(count(case when hour(ts) between 13 and 18 then 1 end) % 4 as double) as s3,
    cast(count(case when hour(ts) between 19 and 23 then 1 end) % 4 as double) as s4,
    cast(row_number() over (partition by 1 + user_id % 7 order by cast(ts as date)) - 1 as integer) as day_offset
  from events where ts >= timestamp '2024-01-25 00:00:00' group by 1 + user_id % 7, cast(ts as date)""",
    "forecasts": """
  select weather_index, day_offset, day, temperature_max, temperature_min, rain_from, rain_to,
    s1 as slot_1, s2 as slot_2, case when has_slot_3 then s3 end as slot_3, case when has_slot_4 then s4 end as slot_4,
    true as has_slot_1, true as has_slot_2, has_slot_3, has_slot_4
  from (select *,
    date_diff('day', date '2024-01-25', day) < 2 or (date_diff('day', date '2024-01-25', day) = 4 and weather_index = 7) as has_slot_3,
    date_diff('day', date '2024-01-25', day) < 2 as has_slot_4 from daily)""",
    "grid": """
  select station_id, weather_index, o.day_offset, h.hour, cast(date '2024-01-25' + o.day_offset as date) as day,
    temperature_max, temperature_min, rain_from, rain_to, slot_1, slot_2, slot_3, slot_4,
    has_slot_1, has_slot_2, has_slot_3, has_slot_4
  from stations
  join (select weather_index, date_diff('day', date '2024-01-25', arg_max(day, day_offset)) as horizon
        from forecasts group by 1) using (weather_index)
  join (select cast(range as integer) as day_offset from range(0, 60)) o on o.day_offset <= horizon
  cross join (select cast(range as integer) as hour from range(0, 24)) h
  join (select * exclude (day) from forecasts) f using (weather_index, day_offset)""",
    "complete": "select * from panel where temperature is not null and niederschlag is not null",
    "level_long": """
  select station_id, obs_id, temperature, niederschlag, hour, week_day, 'TRAFFIC_1' as target, traffic_1 as label from complete
  union all
  select station_id, obs_id, temperature, niederschlag, hour, week_day, 'TRAFFIC_2' as target, traffic_2 as label from complete""",
    "split_rows": """
  select *, case when cast(('0x' || substr(md5('holdout101:' || obs_id), 1, 8)) as bigint) % 5 = 0 then 'test' else 'train' end as split
  from level_long""",
    "placed": """
  select *, row_number() over (partition by station_id, target, split, label order by obs_id) - 1 as position from split_rows""",
    "sizes": "select station_id, target, split, label, count(*) as n_rows from split_rows group by all",
    "classes": """
  select station_id, target, split, list(label order by label) as class_list, list(n_rows order by label) as size_list
  from sizes group by all""",
    "picks": """
  select station_id, target, split, obs_id as draw_id, class_list, size_list,
    cast(cast(('0x' || substr(md5('class101:' || target || ':' || obs_id), 1, 8)) as bigint) % len(class_list) as integer) + 1 as chosen
  from split_rows join classes using (station_id, target, split)""",
    "draws": """
  select station_id, target, split, draw_id, class_list[chosen] as label,
    cast(('0x' || substr(md5('row101:' || target || ':' || draw_id), 1, 8)) as bigint) % size_list[chosen] as position
  from picks""",
    "resampled": """
  select d.station_id, d.target, d.split, d.draw_id, d.label, p.obs_id, p.temperature, p.niederschlag, p.hour, p.week_day
  from draws d join placed p using (station_id, target, split, label, position)""",
    "points": """
  select station_id, target, split, label, temperature, niederschlag, cast(hour as double) as hour,
    cast(week_day as double) as week_day, count(*) as n
  from resampled group by all""",
    "asked": """
  select distinct station_id, target, temperature, niederschlag, hour, week_day from points where split = 'test'""",
    "measured": """
  select a.*, t.label, t.n,
    (a.temperature - t.temperature) * (a.temperature - t.temperature)
    + (a.niederschlag - t.niederschlag) * (a.niederschlag - t.niederschlag)
    + (a.hour - t.hour) * (a.hour - t.hour) + (a.week_day - t.week_day) * (a.week_day - t.week_day) as square
  from asked a join points t on a.station_id = t.station_id and a.target = t.target and t.split = 'train'""",
    "nearest": """
  select *, coalesce(sum(n) over (partition by station_id, target, temperature, niederschlag, hour, week_day
    order by square, label rows between unbounded preceding and 1 preceding), 0) as before
  from (select *, row_number() over (partition by station_id, target, temperature, niederschlag, hour, week_day
    order by square, label) as place from measured) where place <= 4""",
    "tally": """
  select station_id, target, temperature, niederschlag, hour, week_day, label,
    sum(greatest(least(n, 1 - before), 0)) as v1, sum(greatest(least(n, 2 - before), 0)) as v2,
    sum(greatest(least(n, 3 - before), 0)) as v3, sum(greatest(least(n, 4 - before), 0)) as v4
  from nearest where before < 4 group by all""",
    "neighbours": """
  select station_id, target, temperature, niederschlag, hour, week_day,
    arg_max(label, v1 * 10 - label) as predicted_1, arg_max(label, v2 * 10 - label) as predicted_2,
    arg_max(label, v3 * 10 - label) as predicted_3, arg_max(label, v4 * 10 - label) as predicted_4
  from tally group by all""",
    "voted": """
  select p.station_id, p.target, temperature, niederschlag, hour, week_day, p.label, p.n,
    predicted_1 as voter_1, predicted_3 as voter_3, predicted_4 as voter_4,
    case when predicted_3 <> predicted_4 and predicted_4 = predicted_1 then predicted_4 else predicted_3 end as ensemble
  from points p join neighbours using (station_id, target, temperature, niederschlag, hour, week_day)
  where p.split = 'test'""",
}

_NEEDS: dict[str, list[str]] = {
    "peaks": ["counted"],
    "panel": ["counted", "peaks"],
    "sided_peaks": ["counted"],
    "facts": ["counted", "sided_peaks"],
    "forecasts": ["daily"],
    "grid": ["stations", "forecasts"],
    "complete": ["panel"],
    "level_long": ["complete"],
    "split_rows": ["level_long"],
    "placed": ["split_rows"],
    "sizes": ["split_rows"],
    "classes": ["sizes"],
    "picks": ["split_rows", "classes"],
    "draws": ["picks"],
    "resampled": ["draws", "placed"],
    "points": ["resampled"],
    "asked": ["points"],
    "measured": ["asked", "points"],
    "nearest": ["measured"],
    "tally": ["nearest"],
    "neighbours": ["tally"],
    "voted": ["points", "neighbours"],
}


def _chain(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _chain(_NEEDS.get(name, []), seen)
            seen.append(name)
    return seen


def _add(name: str, sql: str, *needs: str) -> None:
    parts = [f"{cte} as materialized ({_CTES[cte].strip()})" for cte in _chain(list(needs), [])]
    ORACLE[name] = ("with " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


def _case(column: str, values: dict, default: str = "null") -> str:
    whens = " ".join(f"when {k} then {v}" for k, v in values.items())
    return f"case {column} {whens} else {default} end"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PARTS = "cast(day(ts) as integer) as day, cast(month(ts) as integer) as month, cast(year(ts) as integer) as year"
_PLAIN_DATE = "year({d}) || '-' || month({d}) || '-' || day({d})"

_add("hourly_panel", "select * from panel", "panel")
_add("merged_sources", "select * from panel", "panel")
_add(
    "station_series",
    "select station_id, cast(year(ts) as integer) as year, "
    + ", ".join(
        f"string_agg({value}, ',' order by ts) as {name}"
        for name, value in [
            ("traffic_1", "traffic_1"),
            ("traffic_2", "traffic_2"),
            ("days", "day(ts)"),
            ("months", "month(ts)"),
            ("years", "year(ts)"),
            ("hours", "hour"),
            ("count_1", "count_1"),
            ("count_2", "count_2"),
        ]
    )
    + " from panel group by 1, 2",
    "panel",
)
_add("bulletin_forecasts", "select * replace (cast(day as varchar) as day) from forecasts", "forecasts")
_add(
    "bulletin_keys",
    """
select weather_index, day_offset,
  case when day_offset < 2 and slot_3 is null then 'rainTimespan3,rainTimespan4' else '' end as missing_keys,
  not (day_offset < 2 and slot_3 is null) as complete
from forecasts""",
    "forecasts",
)
_add(
    "prediction_export",
    """
select station_id, traffic_1 as "TRAFFIC_1", traffic_2 as "TRAFFIC_2", cast(day(ts) as integer) as "DAY",
  cast(month(ts) as integer) as "MONTH", cast(year(ts) as integer) as "YEAR", hour as "HOUR",
  count_1 as "COUNT_1", count_2 as "COUNT_2"
from panel""",
    "panel",
)
ORACLE["assembled_predictions"] = ORACLE["prediction_export"]
_add("station_code", "select station_id, station_index, lpad(cast(station_id as varchar), 8, '0') as station_code from stations", "stations")
_add(
    "calendar_features",
    f"select station_id, strftime(ts, '%y%m%d_%H') as date_hours, week_day, hour, {_PARTS} from panel",
    "panel",
)
_add("complete_rows", "select obs_id, temperature, niederschlag, traffic_1, traffic_2 from complete", "complete")
_PANEL = ["station_id", "ts", "count_1", "count_2", "temperature", "niederschlag", "traffic_1", "traffic_2", "hour", "week_day", "obs_id"]
_add("null_counts", "select " + ", ".join(f"count(*) - count({c}) as {c}" for c in _PANEL) + " from panel", "panel")
_add(
    "eligible_stations",
    "select station_id, weather_index, n_rows from stations join (select station_id, count(*) as n_rows from panel group by 1) "
    "using (station_id) where n_rows > 1",
    "stations",
    "panel",
)
_add(
    "eligible_rows",
    "select station_id, obs_id from panel where station_id in (select station_id from panel group by 1 having count(*) > 1)",
    "panel",
)
_add(
    "level_rows",
    "select obs_id, 'TRAFFIC_1' as target, traffic_1 as label from panel where traffic_1 between 1 and 4 "
    "union all select obs_id, 'TRAFFIC_2', traffic_2 from panel where traffic_2 between 1 and 4",
    "panel",
)
_add(
    "station_filter",
    "select station_id, weather_index, obs_id, traffic_1, traffic_2 from panel join stations using (station_id) where station_id = 2",
    "panel",
    "stations",
)
_add(
    "minute_slider",
    "select event_id, cast(hour(ts) as integer) as hour, lpad(cast(minute(ts) as varchar), 2, '0') as minute from events",
)
_add("days_ahead", "select obs_id, cast(date_diff('day', date '2024-01-25', cast(ts as date)) as integer) as days from panel", "panel")
_add(
    "forecast_horizon",
    "select weather_index, cast(date_diff('day', date '2024-01-25', max(day)) as integer) as horizon from forecasts group by 1",
    "forecasts",
)
_add(
    "bool_int_clamp",
    """
select event_id, case when event_type <> 'view' and value > 50 then 1 else 0 end as high_value,
  cast(case when value is not null then greatest(trunc(value - 50), 0) end as integer) as clamped, round(abs(ln(value + 1)), 6) as log_value
from events""",
)
_RULES = [
    ("traffic_1", "between 0 and 4"),
    ("traffic_2", "between 0 and 4"),
    ("day", "between 1 and 31"),
    ("month", "between 1 and 12"),
    ("year", "between 2000 and 2999"),
    ("hour", "between 0 and 23"),
    ("week_day", "between 0 and 6"),
    ("count_1", ">= 0"),
    ("count_2", ">= 0"),
    ("niederschlag", ">= 0"),
]
_add(
    "quality_report",
    " union all ".join(
        f"select '{c}' as column_name, count(case when not ({c} {rule}) then 1 end) as out_of_range, "
        f"count(*) - count({c}) as null_rows, count(*) as n_rows from (select *, {_PARTS} from panel)"
        for c, rule in _RULES
    ),
    "panel",
)
_add(
    "fact_view",
    "select obs_id, case when ts < timestamp '2024-01-25 00:00:00' then 'history' else 'prediction' end as origin, "
    "traffic_1, traffic_2, count_1, count_2 from facts",
    "facts",
)
_AT = "(select station_id, traffic_{d} as level from facts where ts = timestamp '2024-01-15 08:00:00')"
_add(
    "traffic_at",
    f"select station_id, coalesce(level, -1) as level from stations left join {_AT.format(d=1)} using (station_id)",
    "stations",
    "facts",
)
_ICONS = {k: _text(v) for k, v in _ICON_BY_LEVEL.items()}
_add(
    "marker_icons",
    f"select station_id, latitude, longitude, coalesce(level, -1) as level, {_case('level', _ICONS, _text(_ICON_DEFAULT))} as icon "
    f"from stations left join {_AT.format(d=2)} using (station_id)",
    "stations",
    "facts",
)
_INFOBOX = _text(_BOX).replace("{", "' || ").replace("}", " || '")
_add(
    "marker_infobox",
    f"select station_id, station_index, {_text(_ICON_DEFAULT)} as icon, latitude as lat, longitude as lng, {_INFOBOX} as infobox from stations",
    "stations",
)
_add(
    "latest_per_hour",
    f"""
select station_id, {_PLAIN_DATE.format(d="ts")} || ':' || hour(ts) || ':00' as lookup_key, event_type, value
from (select cast(2 + user_id // 10 as integer) as station_id, date_trunc('hour', ts) as ts, event_type, value,
  row_number() over (partition by user_id // 10, date_trunc('hour', ts) order by event_id desc) as place from events)
where place = 1""",
)
_add(
    "by_date_lists",
    "select station_id, cast(cast(ts as date) as varchar) as day, cast(count(*) as integer) as n_hours, "
    + ", ".join(f"string_agg({c}, ',' order by ts) as {c}" for c in ("hour", "traffic_1", "traffic_2", "count_1", "count_2"))
    + " from facts group by 1, 2",
    "facts",
)
_COLOURS = {k: _text(name) for k, name in _COLOUR_NAMES.items()}
_LONG = (
    "select *, 1 as direction, traffic_1 as level, count_1 as cnt from facts union all "
    "select *, 2 as direction, traffic_2 as level, count_2 as cnt from facts"
)
_CELLS = ", ".join(
    f"""max(case when day = '{day}' then level end) as "{day}_level", max(case when day = '{day}' then greatest(cnt, 0) end) as "{day}_count", """
    f"""max(case when day = '{day}' then {_case("level", _COLOURS)} end) as "{day}_colour\""""
    for day in [f"2024-01-{d}" for d in range(25, 31)]
)
_add(
    "heatmap",
    f"""
, cells as (select station_id, direction, hour, cast(cast(ts as date) as varchar) as day, level, cnt from ({_LONG})
  where ts >= timestamp '2024-01-25 00:00:00')
select station_id, direction, h.hour, {_CELLS}
from (select distinct station_id, direction from cells) cross join (select cast(range as integer) as hour from range(0, 24)) h
left join cells using (station_id, direction, hour) group by all""",
    "facts",
)
_add(
    "heatmap_cells",
    f"select station_id, cast(direction as integer) as direction, cast(cast(ts as date) as varchar) as day, hour, level, "
    f"greatest(cnt, 0) as count, {_case('level', _COLOURS)} as colour from ({_LONG})",
    "facts",
)
_RGB = [{k: rgb[i] for k, rgb in _COLOUR_RGB.items()} for i in range(3)]
_add(
    "heatmap_colours",
    f"select obs_id, direction, {_case('level', _COLOURS)} as colour, "
    + ", ".join(f"{_case('level', values)} as {name}" for name, values in zip("rgb", _RGB))
    + f" from ({_LONG.replace('from facts', 'from panel')})",
    "panel",
)
_add(
    "day_headers",
    f"select distinct cast(cast(ts as date) as varchar) as day, dayname(ts) || ', ' || {_PLAIN_DATE.format(d='ts')} as header from panel",
    "panel",
)
_add(
    "direction_labels",
    """
select station_id, abitato_sito_i || '/' || abitato_sito_d as station,
  'From: ' || descrizione_i_2 || ' / ' || descrizione_d_2 || ' to: ' || descrizione_i_1 || '/' || descrizione_d_1 as direction_1,
  'From: ' || descrizione_i_1 || ' / ' || descrizione_d_1 || ' to: ' || descrizione_i_2 || '/' || descrizione_d_2 as direction_2,
  'From ' || descrizione_i_1 || ' to ' || descrizione_i_2 as console_1,
  'From ' || descrizione_i_2 || ' to ' || descrizione_i_1 as console_2
from stations""",
    "stations",
)
_ZONES = [
    f"{_case('weather_index', {k: _text(v) for k, v in _ZONE_NAMES[lang].items()}, _text(_ZONE_UNKNOWN))} as zone_{lang}"
    for lang in ("it", "de")
]
_add("weather_names", f"select station_id, weather_index, {', '.join(_ZONES)} from stations", "stations")
_add("weather_zones_used", "select distinct weather_index from stations", "stations")
_add(
    "colon_lists",
    "select station_id, abitato_sito_i || ':' || abitato_sito_d || ':' || descrizione_i_1 || ':' || descrizione_i_2 || ':' as joined, "
    "4 as n_pieces, descrizione_i_2 as last_piece from stations",
    "stations",
)
_DECODED = "html"
for _name, _char in _ENTITIES:
    _DECODED = f"replace({_DECODED}, {_text(f'&{_name};')}, {_text(_char)})"
_add("decode_entities", f"select page_id, {_DECODED} as decoded from pages")
_add(
    "url_param",
    "select page_id, "
    + ", ".join(f"nullif(regexp_extract(url, '[?&]{p}=([^&#=]*)', 1), '') as {p}" for p in ("page", "ref", "utm_source"))
    + " from pages",
)
_add(
    "forecast_grid",
    "select station_id, day_offset, hour, cast(day as varchar) as day, temperature_max, rain_to from grid",
    "grid",
)
_SPREAD = """case when cast(temperature_max as integer) > cast(temperature_min as integer) then
  sqrt((cast(temperature_max as integer) - cast(temperature_min as integer) + 1.0)
    * (cast(temperature_max as integer) - cast(temperature_min as integer) + 2) / 12.0) else 0.0 end"""
_RANK = "case when hour < 12 then hour else 23 - hour end"
_SLOT = """case when not has_slot_3 and not has_slot_4 then case when hour <= 12 then slot_1 else slot_2 end
  when has_slot_3 and has_slot_4 then
    case when hour <= 6 then slot_1 when hour <= 12 then slot_2 when hour <= 18 then slot_3 else slot_4 end
  else -1 end"""
_SHOWN = """select station_id, hour, cast(isodow(day) - 1 as integer) as week_day, cast(day(day) as integer) as day,
  cast(month(day) as integer) as month, cast(year(day) as integer) as year,
  round((temperature_max + temperature_min) / 2.0 + {spread} * {z}, 6) as temperature,
  round(case when coalesce({slot} = 0, false) or rain_from + rain_to <= 0 then 0.0 else {amount} end, 6) as niederschlag
from grid"""
_NORMALS = ", ".join(f"cast({z!r} as double)" for z in _ORDER_MEANS)
_add(
    "forecast_features",
    _SHOWN.format(
        spread=_SPREAD,
        z=f"[{_NORMALS}][{_RANK} + 1]",
        slot=_SLOT,
        amount=f"(rain_from + rain_to) / 2.0 * cast({math.exp(0.125)!r} as double) * 0.01 * cast({6 / 11!r} as double)",
    ),
    "grid",
)
_WHERE = "station_id || ':' || strftime(day + to_hours(hour), '%Y-%m-%d %H:%M:%S')"


def _hash(salt: str) -> str:
    return f"cast(('0x' || substr(md5('{salt}:' || {_WHERE}), 1, 8)) as bigint)"


def _normal(salt: str) -> str:
    u, v = (f"(({_hash(f'{salt}:{part}')} + 0.5) / cast(4294967296.0 as double))" for part in "uv")
    return f"(sqrt(-2.0 * ln({u})) * cos(cast({2 * math.pi!r} as double) * {v}))"


_DRAWS = ", ".join(_normal(f"temperature101:{i}") for i in range(12))
_add(
    "sampled_features",
    _SHOWN.format(
        spread=_SPREAD,
        z=f"list_sort([{_DRAWS}])[{_RANK} + 1]",
        slot=_SLOT,
        amount=f"case when {_hash('dice101')} % 11 < 6 then exp(ln((rain_from + rain_to) / 2.0) + 0.5 * {_normal('rain101')}) * 0.01 else 0.0 end",
    ),
    "grid",
)
_FIT = ", ".join(
    f"round(avg({c}), 8) as {c}_mean, round(case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end, 8) as {c}_std"
    for c in ("temperature", "niederschlag")
)
_add("zscore_fit", f"select station_id, {_FIT} from panel group by 1", "panel")
_VALUES = ", ".join(f"array_to_string(list_sort(list(distinct {c})), ',') as {c}_values" for c in ("hour", "week_day"))
_add("incremental_zscore", f"select station_id, count(*) as n_rows, {_FIT}, {_VALUES} from panel group by 1", "panel")
_ZONES = "select station_id, weather_index from stations where weather_index in (select weather_index from daily)"
_REASONS = "case station_id % 5 when 1 then 'not json' when 2 then 'empty' when 3 then 'no forecasts' else 'unreadable date' end"
_add("rejected_bulletins", f"select station_id, weather_index, {_REASONS} as reason from ({_ZONES}) where station_id % 5 <> 0", "stations", "daily")
_add(
    "landed_bulletins",
    "select station_id, weather_index, days from stations join (select weather_index, cast(count(*) as integer) as days from daily group by 1) "
    "using (weather_index) where station_id % 5 = 0",
    "stations",
    "daily",
)
_SCALED = (
    "select complete.*, " + ", ".join(f"({c} - m_{c}) / s_{c} as {c}_z" for c in ("temperature", "niederschlag")) + " from complete join "
    "(select station_id, "
    + ", ".join(
        f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end as s_{c}" for c in ("temperature", "niederschlag")
    )
    + " from complete group by 1) using (station_id)"
)
_add(
    "zscore_apply",
    f"select obs_id, round(temperature_z, 5) as temperature_z, round(niederschlag_z, 5) as niederschlag_z from ({_SCALED})",
    "complete",
)
_add(
    "onehot_fit",
    "select station_id, array_to_string(list_sort(list(distinct hour)), ',') as hour_values, "
    "array_to_string(list_sort(list(distinct week_day)), ',') as week_day_values from panel group by 1",
    "panel",
)
_add(
    "feature_vector",
    f"""
, known as (select station_id, list_sort(list(distinct hour)) as hours, list_sort(list(distinct week_day)) as days from complete group by 1)
select obs_id, cast(len(hours) + len(days) + 2 as integer) as width, cast(list_position(hours, hour) - 1 as integer) as hour_place,
  cast(len(hours) + list_position(days, week_day) - 1 as integer) as week_day_place,
  round(niederschlag_z, 5) as rain_z, round(temperature_z, 5) as temperature_z
from ({_SCALED}) join known using (station_id)""",
    "complete",
)
_add(
    "minmax_roundtrip",
    """
, rows as (select station_id, obs_id, 'COUNT_1' as target, count_1 as label from panel
  union all select station_id, obs_id, 'COUNT_2', count_2 from panel),
fitted as (select station_id, target, min(label) as low, max(label) as high from rows group by 1, 2)
select obs_id, target, round((label - low) / cast(case when high = low then 1 else high - low end as double), 6) as scaled,
  cast(label as double) as restored
from rows join fitted using (station_id, target)""",
    "panel",
)
_add(
    "holdout_split",
    "select obs_id, case when cast(('0x' || substr(md5('holdout101:' || obs_id), 1, 8)) as bigint) % 5 = 0 then 'test' else 'train' end as split from panel",
    "panel",
)
_add(
    "class_counts",
    "select station_id, 'TRAFFIC_1' as target, traffic_1 as label, count(*) as n_rows from panel group by 1, 3 "
    "union all select station_id, 'TRAFFIC_2', traffic_2, count(*) from panel group by 1, 3",
    "panel",
)
_add("balanced_resample", "select target, split, draw_id, obs_id, label from resampled", "resampled")
_add(
    "resample_diff",
    """
select obs_id, target, label, 'left' as side from
  (select obs_id, target, label from level_long except all select obs_id, target, label from resampled)
union all
select obs_id, target, label, 'right' as side from
  (select obs_id, target, label from resampled except all select obs_id, target, label from level_long)""",
    "level_long",
    "resampled",
)
ORACLE["range_diff"] = ORACLE["resample_diff"]
_LEVELS = "select obs_id, traffic_1, traffic_2 from"
_add(
    "revised_levels",
    f"select *, 'left' as side from ({_LEVELS} panel except all {_LEVELS} facts) "
    f"union all select *, 'right' as side from ({_LEVELS} facts except all {_LEVELS} panel)",
    "panel",
    "facts",
)
_add("knn_predict", "select * from neighbours", "neighbours")
_BY_K = " union all ".join(
    f"select station_id, target, {k} as k, p.label, p.n, predicted_{k} as predicted "
    "from points p join neighbours using (station_id, target, temperature, niederschlag, hour, week_day) where p.split = 'test'"
    for k in range(1, 5)
)
_add(
    "knn_best_k",
    f"""
, rates as (select station_id, target, k,
  cast(sum(case when label = predicted then n else 0 end) as double) / cast(sum(n) as double) as test_accuracy from ({_BY_K}) group by 1, 2, 3)
select station_id, target, k, round_even(test_accuracy, 3) as test_accuracy from
  (select *, row_number() over (partition by station_id, target order by test_accuracy desc, k) as place from rates) where place = 1""",
    "points",
    "neighbours",
)
_add(
    "ensemble_vote",
    "select station_id, target, temperature, niederschlag, hour, week_day, label, n, voter_1, voter_3, voter_4, ensemble from voted",
    "voted",
)
_RATE = "select station_id, target, round_even(sum(case when label = {p} then n else 0 end) / cast(sum(n) as double), 3) as accuracy from voted group by 1, 2"
_add("accuracy", _RATE.format(p="voter_3"), "voted")
_add("ensemble_accuracy", _RATE.format(p="ensemble"), "voted")
_add(
    "smape",
    """
select station_id, round_even(avg(error), 3) as mean_percentage_error, count(*) - count(error) as undefined_rows
from (select station_id, round_even(abs(cast(count_1 as double) - count_2) / nullif((count_1 + count_2) / 2.0, 0) * 100, 3) as error from panel)
group by 1""",
    "panel",
)
_add(
    "mse",
    "select station_id, round_even(avg(cast((count_1 - count_2) * (count_1 - count_2) as double)), 3) as mean_squared_error from panel group by 1",
    "panel",
)

# --- files ------------------------------------------------------------------------------------------------------------

_add(
    "history_files",
    """
select station_id, lpad(cast(station_id as varchar), 8, '0') as station_code, ts, strftime(ts, '%y%m%d_%H') as date_hours,
  round(temperature, 4) as temperature, round(niederschlag, 4) as niederschlag, traffic_1, traffic_2, count_1, count_2 from panel""",
    "panel",
)
_add("station_file", "select * exclude (station_index) from stations", "stations")
_add("prediction_files", "select station_id, ts, traffic_1, traffic_2, count_1, count_2 from panel", "panel")
_add(
    "prediction_table",
    "select station_id, weather_index, cast(cast(ts as date) as varchar) as day, hour, traffic_1, traffic_2, count_1, count_2 "
    "from panel join stations using (station_id)",
    "panel",
    "stations",
)
_add(
    "model_table",
    "select station_id, 'COUNT_1' as target, min(count_1) as low, max(count_1) as high, 'scaler_number_vehicles' as model_name from panel group by 1 "
    "union all select station_id, 'COUNT_2', min(count_2), max(count_2), 'scaler_number_vehicles' from panel group by 1",
    "panel",
)

# --- networks and scoring ---------------------------------------------------------------------------------------------

_add(
    "network_loss",
    """
, long as (select station_id, obs_id, hour, week_day, 'COUNT_1' as target, count_1 as label from complete
  union all select station_id, obs_id, hour, week_day, 'COUNT_2', count_2 from complete),
fitted as (select station_id, target, min(label) as low, max(label) as high from long group by 1, 2)
select station_id, target,
  case when cast(('0x' || substr(md5('holdout101:' || obs_id), 1, 8)) as bigint) % 5 = 0 then 'test' else 'train' end as split,
  round_even(avg(power((label - low) / cast(case when high = low then 1 else high - low end as double) - (hour + week_day) / 32.0, 2)), 3) as loss
from long join fitted using (station_id, target) group by 1, 2, 3""",
    "complete",
)
_CTES["observed"] = """
  select * from (select *, count(*) over (partition by station_id) as n_known from facts where not later and station_id in (select station_id from stations))
  where n_known > 1 and temperature is not null and niederschlag is not null"""
_NEEDS["observed"] = ["facts", "stations"]
_add(
    "unscored",
    """
, horizons as (select weather_index, date_diff('day', date '2024-01-25', arg_max(day, day_offset)) as horizon from forecasts group by 1)
select station_id, cast(null as varchar) as day, 'no history' as reason from stations where station_id not in (select station_id from observed)
union all
select station_id, null, 'no bulletin' from stations where weather_index not in (select weather_index from horizons where horizon >= 0)
union all
select station_id, cast(cast(date '2024-01-25' + cast(o.range as integer) as date) as varchar), 'no forecast'
from stations join horizons using (weather_index) join range(0, 60) o on o.range <= horizon
where not exists (select 1 from forecasts f where f.weather_index = stations.weather_index and f.day_offset = o.range)""",
    "observed",
    "stations",
    "forecasts",
)
_add(
    "scored_cells",
    """
select station_id, strftime(day + to_hours(hour), '%Y-%m-%d %H:%M') as at, true as valid
from grid where station_id in (select station_id from observed)""",
    "grid",
    "observed",
)
_add(
    "trained_models",
    """
, names as (
  select unnest(['TRAFFIC_1', 'TRAFFIC_2']) as target, m.model, m.metric from (
    select unnest(['simple_tree', 'tree', 'forest', 'neighbours', 'ensemble']) as model, 'accuracy' as metric
    union all
    select model, 'importance of ' || feature from (select unnest(['simple_tree', 'tree', 'forest']) as model)
      cross join (select unnest(['temperature', 'niederschlag', 'hour', 'week_day']) as feature)) m
  union all
  select unnest(['COUNT_1', 'COUNT_2']), m.model, m.metric from (select 'network' as model, unnest(['loss', 'percentage_error']) as metric) m)
select distinct station_id, target, model, metric, true as valid from observed cross join names""",
    "observed",
)

# --- trees of depth 2 --------------------------------------------------------------------------------------------------

_NAMED = ["temperature", "niederschlag", "hour", "week_day"]
_CLASSES = [1, 2, 3, 4]


def _cut_ctes(level: int | str, rows: str) -> dict[str, str]:
    """Best cut of each node of a level: `rows` holds the training points with their node."""
    counts = ", ".join(f"sum(case when label = {c} then n else 0 end) as c{c}" for c in _CLASSES)
    values = " union all ".join(
        f"select station_id, target, node, {i} as f, {name} as v, {counts} from {rows} group by 1, 2, 3, 5" for i, name in enumerate(_NAMED)
    )
    one, all_ = "(partition by station_id, target, node, f order by v)", "(partition by station_id, target, node, f)"
    running = ", ".join(f"sum(c{c}) over {one} as l{c}, sum(c{c}) over {all_} as t{c}" for c in _CLASSES)
    left, right = "+".join(f"l{c}" for c in _CLASSES), "+".join(f"(t{c}-l{c})" for c in _CLASSES)
    left_squares = "+".join(f"cast(l{c} as double)*l{c}" for c in _CLASSES)
    right_squares = "+".join(f"cast(t{c}-l{c} as double)*(t{c}-l{c})" for c in _CLASSES)
    total, squares = "+".join(f"t{c}" for c in _CLASSES), "+".join(f"cast(t{c} as double)*t{c}" for c in _CLASSES)
    purity = f"({left_squares}) / cast({left} as double) + ({right_squares}) / cast({right} as double)"
    order = "(partition by station_id, target, node order by purity desc, f, v)"
    return {
        f"values_{level}": values,
        f"best_{level}": f"""
  select station_id, target, node, f, v, following, (v + following) / 2 as threshold, purity - ({squares}) / cast({total} as double) as lost from (
    select *, row_number() over {order} as place from (
      select *, {purity} as purity from (
        select *, lead(v) over {one} as following, {running} from values_{level})
      where following is not null and greatest(t1, t2, t3, t4) < {total}))
  where place = 1""",
    }


_CTES["train_points"] = "select *, 0 as node from points where split = 'train'"
_NEEDS["train_points"] = ["points"]
_CTES |= _cut_ctes(0, "train_points")
_NEEDS["values_0"], _NEEDS["best_0"] = ["train_points"], ["values_0"]
_SIDE = "case f " + " ".join(f"when {i} then {name}" for i, name in enumerate(_NAMED)) + " end > threshold"
# Children of the root are 1 and 2; those of level 1 count on from 3, in the order of the nodes that are cut.
_CTES["lower_points"] = f"""
  select p.station_id, p.target, p.split, p.temperature, p.niederschlag, p.hour, p.week_day, p.label, p.n,
    cast(case when f is null then 0 when {_SIDE} then 2 else 1 end as integer) as node
  from points p left join best_0 b on b.station_id = p.station_id and b.target = p.target"""
_NEEDS["lower_points"] = ["points", "best_0"]
_CTES["train_lower"] = "select * from lower_points where split = 'train' and node > 0"
_NEEDS["train_lower"] = ["lower_points"]
_CTES |= _cut_ctes(1, "train_lower")
_NEEDS["values_1"], _NEEDS["best_1"] = ["train_lower"], ["values_1"]
_CTES["numbered"] = "select *, 1 + 2 * row_number() over (partition by station_id, target order by node) as lower from best_1"
_NEEDS["numbered"] = ["best_1"]
_CTES["leaves"] = f"""
  select p.* exclude (node), cast(case when f is null then p.node when {_SIDE} then lower + 1 else lower end as integer) as node
  from lower_points p left join numbered b on b.station_id = p.station_id and b.target = p.target and b.node = p.node"""
_NEEDS["leaves"] = ["lower_points", "numbered"]
_NAME_OF = "case f " + " ".join(f"when {i} then '{name}'" for i, name in enumerate(_NAMED)) + " end"
_add(
    "simple_tree",
    f"""
, inner_nodes as (select station_id, target, node, f, threshold from best_0 union all select station_id, target, node, f, threshold from best_1),
ends as (select distinct station_id, target, node from leaves where split = 'train')
select station_id, target, node, {_NAME_OF} as feature, round(threshold, 6) as threshold from inner_nodes
union all
select station_id, target, node, null, 0.0 from ends""",
    "best_0",
    "best_1",
    "leaves",
)
_SHARES = ", ".join(f"round(cast(cast(sum(case when label = {c} then n else 0 end) as double) / sum(n) as float), 5) as s{c}" for c in _CLASSES)
_add(
    "tree_fit_metrics",
    f"""
, decided as (
  select station_id, target, node, case greatest(s1, s2, s3, s4) when s1 then 1 when s2 then 2 when s3 then 3 else 4 end as predicted
  from (select station_id, target, node, {_SHARES} from leaves where split = 'train' group by 1, 2, 3))
select station_id, target, split, round_even(sum(case when label = predicted then n else 0 end) / cast(sum(n) as double), 3) as accuracy
from leaves join decided using (station_id, target, node) group by 1, 2, 3""",
    "leaves",
)
ORACLE["tree_scores_native"] = ORACLE["tree_fit_metrics"]
_add(
    "tree_importances",
    """
, lost as (select station_id, target, f, lost from best_0 union all select station_id, target, f, lost from best_1),
named as (select distinct station_id, target, x.f, x.feature from train_points
  cross join (select unnest([0, 1, 2, 3]) as f, unnest(['temperature', 'niederschlag', 'hour', 'week_day']) as feature) x)
select station_id, target, feature, round(coalesce(sum(lost), 0.0) / greatest(coalesce(max(whole), 0.0), 1e-300), 6) as importance
from named left join lost using (station_id, target, f)
  left join (select station_id, target, sum(lost) as whole from lost group by 1, 2) using (station_id, target)
group by 1, 2, 3""",
    "train_points",
    "best_0",
    "best_1",
)

# The same trees over bins: every feature of a key is cut into 16 of about equal weight, and its number stands for the value.
_CTES["bin_values"] = " union all ".join(
    f"select station_id, target, {i} as f, {name} as v, sum(n) as n from points where split = 'train' group by 1, 2, 4" for i, name in enumerate(_NAMED)
)
_NEEDS["bin_values"] = ["points"]
_CTES["bin_rows"] = """
  select station_id, target, f, v, dense_rank() over (partition by station_id, target, f order by part) - 1 as bin from (
    select *, case when count(*) over (partition by station_id, target, f) <= 16
        then row_number() over (partition by station_id, target, f order by v)
        else floor(coalesce(sum(n) over (partition by station_id, target, f order by v rows between unbounded preceding and 1 preceding), 0) * 16
          / sum(n) over (partition by station_id, target, f)) end as part
    from bin_values)"""
_NEEDS["bin_rows"] = ["bin_values"]
_CTES["binned_points"] = (
    "select p.station_id, p.target, p.label, "
    + ", ".join(f"b{i}.bin as {name}" for i, name in enumerate(_NAMED))
    + ", p.n, 0 as node from points p "
    + " ".join(
        f"join bin_rows b{i} on b{i}.station_id = p.station_id and b{i}.target = p.target and b{i}.f = {i} and b{i}.v = p.{name}"
        for i, name in enumerate(_NAMED)
    )
    + " where p.split = 'train'"
)
_NEEDS["binned_points"] = ["points", "bin_rows"]
_CTES |= _cut_ctes("b0", "binned_points")
_NEEDS["values_b0"], _NEEDS["best_b0"] = ["binned_points"], ["values_b0"]
_CTES["binned_lower"] = f"""
  select p.* exclude (node), case when {_SIDE} then 2 else 1 end as node
  from binned_points p join best_b0 b on b.station_id = p.station_id and b.target = p.target"""
_NEEDS["binned_lower"] = ["binned_points", "best_b0"]
_CTES |= _cut_ctes("b1", "binned_lower")
_NEEDS["values_b1"], _NEEDS["best_b1"] = ["binned_lower"], ["values_b1"]
_add(
    "histogram_tree",
    f"""
, cuts as (select station_id, target, node, f, v, following from best_b0 union all select station_id, target, node, f, v, following from best_b1),
spans as (select station_id, target, f, bin, min(v) as low, max(v) as high from bin_rows group by all),
numbered_b as (select *, 1 + 2 * row_number() over (partition by station_id, target order by node) as lower from best_b1),
ends as (
  select station_id, target, 0 as node from (select distinct station_id, target from binned_points) anti join best_b0 using (station_id, target)
  union all select distinct l.station_id, l.target, l.node from binned_lower l anti join best_b1 b using (station_id, target, node)
  union all select station_id, target, unnest([lower, lower + 1]) from numbered_b)
select c.station_id, c.target, c.node, {_NAME_OF.replace(" f ", " c.f ")} as feature, round((a.high + b.low) / 2, 6) as threshold
from cuts c join spans a on a.station_id = c.station_id and a.target = c.target and a.f = c.f and a.bin = c.v
  join spans b on b.station_id = c.station_id and b.target = c.target and b.f = c.f and b.bin = c.following
union all
select station_id, target, cast(node as integer), null, 0.0 from ends""",
    "bin_rows",
    "binned_lower",
    "best_b0",
    "best_b1",
)

_add(
    "model_versions",
    """
, twice as (
  select station_id, 'COUNT_1' as target, count_1 as c, false as later from panel
  union all select station_id, 'COUNT_2', count_2, false from panel
  union all select station_id, 'COUNT_1', count_1, true from facts where not later and station_id % 2 = 0
  union all select station_id, 'COUNT_2', count_2, true from facts where not later and station_id % 2 = 0)
select station_id, target, min(c) as low, max(c) as high, case when later then 2 else 1 end as saved_in
from twice group by station_id, target, later
qualify row_number() over (partition by station_id, target order by later desc) = 1""",
    "panel",
    "facts",
)
