import datetime as dt
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from roadpulse.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", spark__ui__enabled="false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def one(spark):
    """Value of one expression over one row."""

    def run(expression, **columns):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(1).alias("_"))
        return row.select(expression.alias("value")).collect()[0]["value"]

    return run


STATION_HEADER = (
    "SITI_CODSITO,WEATHER_INDEX,latitude,longitude,ABITATO_SITO_I,ABITATO_SITO_D,FW_NAME_CUSTOM_I,FW_NAME_CUSTOM_D,"
    "DESCRIZIONE_I_1,DESCRIZIONE_D_1,DESCRIZIONE_I_2,DESCRIZIONE_D_2,NAME_I,NAME_D"
)


@pytest.fixture()
def station_file(tmp_path):
    rows = [
        "2,1,46.5,11.3,Ora,Auer,SS12,Straße 12,Bolzano,Bozen,Trento,Trient,Val Venosta,Vinschgau",
        "13,7,46.7,11.6,Lato: est,Süd,SS49,Straße 49,Brunico,Bruneck,Fortezza,Franzensfeste,Ladinia,Ladinien",
        "100,9,46.6,11.1,Merano,Meran,SS38,Straße 38,Sluderno,Schluderns,,Mals,Zona,Zone",
    ]
    path = tmp_path / "stations.csv"
    path.write_bytes("\n".join([STATION_HEADER, *rows]).encode("iso-8859-1"))
    return str(path)


@pytest.fixture()
def history_folder(tmp_path):
    """Stations 2 (3 days, learnable), 13 (one row), 100 (3 days), 7 (no rows)."""
    folder = tmp_path / "history"
    folder.mkdir()
    header = "DATE_HOURS,SCODE,TEMPERATURE,NIEDERSCHLAG,TRAFFIC_1,TRAFFIC_2,COUNT_1,COUNT_2"
    draw = random.Random(5)

    def line(ts, temperature=None):
        level = 1 + ts.hour // 6
        warm = round(draw.uniform(-5, 25), 1) if temperature is None else temperature
        rain = round(draw.uniform(0, 3), 1)
        return f"{ts:%y%m%d_%H},x,{warm},{rain},{level},{5 - level},{level * 40},{ts.hour * 3}"

    start = dt.datetime(2018, 1, 1)
    days = [line(start + dt.timedelta(hours=h)) for h in range(21 * 24)]
    gap = f"{start + dt.timedelta(days=21):%y%m%d_%H},x,,0.0,1,4,40,0"
    (folder / "00000002.csv").write_text("\n".join([header, *days, gap]) + "\n")
    (folder / "00000100.csv").write_text("\n".join([header, *days[: 14 * 24]]) + "\n")
    (folder / "00000013.csv").write_text("\n".join([header, days[0]]) + "\n")
    (folder / "00000007.csv").write_text(header + "\n")
    return str(folder)


def bulletin(first_day, days, **changes):
    """A bulletin as a dict; the first two days have four slots."""
    entries = []
    for i in range(days):
        day = first_day + dt.timedelta(days=i)
        entry = {
            "date": f"{day:%Y-%m-%dT00:00:00}", "temperatureMax": 20 + i, "temperatureMin": 10, "rainFrom": 2, "rainTo": 6,
            "rainTimespan1": 1, "rainTimespan2": 0,
        }
        if i < 2:
            entry.update(rainTimespan3=2, rainTimespan4=0)
        entry.update(changes.get(f"day_{i}", {}))
        entries.append({k: v for k, v in entry.items() if v != "drop"})
    return {"forecasts": entries}
