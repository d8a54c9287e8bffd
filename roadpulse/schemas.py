"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

HISTORY = T.StructType(
    [
        T.StructField("DATE_HOURS", T.StringType()),
        T.StructField("SCODE", T.StringType()),
        T.StructField("TEMPERATURE", T.DoubleType()),
        T.StructField("NIEDERSCHLAG", T.DoubleType()),
        T.StructField("TRAFFIC_1", T.IntegerType()),
        T.StructField("TRAFFIC_2", T.IntegerType()),
        T.StructField("COUNT_1", T.IntegerType()),
        T.StructField("COUNT_2", T.IntegerType()),
    ]
)

STATIONS = T.StructType(
    [
        T.StructField("SITI_CODSITO", T.IntegerType()),
        T.StructField("WEATHER_INDEX", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("ABITATO_SITO_I", T.StringType()),
        T.StructField("ABITATO_SITO_D", T.StringType()),
        T.StructField("FW_NAME_CUSTOM_I", T.StringType()),
        T.StructField("FW_NAME_CUSTOM_D", T.StringType()),
        T.StructField("DESCRIZIONE_I_1", T.StringType()),
        T.StructField("DESCRIZIONE_D_1", T.StringType()),
        T.StructField("DESCRIZIONE_I_2", T.StringType()),
        T.StructField("DESCRIZIONE_D_2", T.StringType()),
        T.StructField("NAME_I", T.StringType()),
        T.StructField("NAME_D", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("TRAFFIC_1", T.IntegerType()),
        T.StructField("TRAFFIC_2", T.IntegerType()),
        T.StructField("DAY", T.IntegerType()),
        T.StructField("MONTH", T.IntegerType()),
        T.StructField("YEAR", T.IntegerType()),
        T.StructField("HOUR", T.IntegerType()),
        T.StructField("COUNT_1", T.IntegerType()),
        T.StructField("COUNT_2", T.IntegerType()),
    ]
)

BULLETIN = "struct<forecasts:array<map<string,string>>>"

FEATURES = ["temperature", "niederschlag", "hour", "week_day"]
LEVELS = [1, 2, 3, 4]
LEVEL_TARGETS = ["TRAFFIC_1", "TRAFFIC_2"]
COUNT_TARGETS = ["COUNT_1", "COUNT_2"]

# What the map viewer and the weather service expect.
ICON_BY_LEVEL = {
    1: "./static/imgs/normal_traffic_logo_resized.png",
    2: "./static/imgs/moderate_traffic_resized.png",
    3: "./static/imgs/high_traffic_resized.png",
    4: "./static/imgs/extreme_traffic_resized.png",
}
ICON_DEFAULT = "./static/imgs/transparent_logo_resized.png"
COLOUR_BY_LEVEL = {
    1: ("color-normal-traffic", (99, 214, 104)),
    2: ("color-moderate-traffic", (240, 125, 2)),
    3: ("color-high-traffic", (230, 0, 0)),
    4: ("color-extreme-traffic", (158, 19, 19)),
}
WEATHER_ZONES = {
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
WEATHER_ZONE_UNKNOWN = "Invalid Weather Station Index. It must be within [1-7]."
HTML_ENTITIES = [
    ("amp", "&"),
    ("apos", "'"),
    ("#x27", "'"),
    ("#x2F", "/"),
    ("#39", "'"),
    ("#47", "/"),
    ("lt", "<"),
    ("gt", ">"),
    ("nbsp", " "),
    ("quot", '"'),
]
INFOBOX = (
    ' <p style="font-size:20px"> <b> Location: </b>  {abitato_sito_i} / {abitato_sito_d}<br>'
    " <b> Street name:  </b> {fw_name_custom_i} / {fw_name_custom_d} <br> "
    " <b> Closest Weather station: </b> {name_i} / {name_d} <br> "
    " <b>Direction 1: </b> From: {descrizione_i_2} / {descrizione_d_2} To: {descrizione_i_1} / {descrizione_d_1} <br>"
    " <b>Direction 2: </b> From: {descrizione_i_1} / {descrizione_d_1} To: {descrizione_i_2} / {descrizione_d_2} <br>"
    " <center><a href=./heatmap?station_id={station_index}> View Traffic Heatmap </a> </p> </center>"
)
