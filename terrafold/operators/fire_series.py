"""The fire-weather recurrence, moisture codes carried from day to day for each station."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.clip import let
from terrafold.functions.models import DC_DAY_FACTOR, DMC_DAY_LENGTH, bui, dc, dmc, ffmc, fwi, isi


def tenth(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


def next_state(temp: float, rh: float, wind: float, rain: float, month: int, state: tuple[float, float, float]) -> tuple[float, float, float]:
    """A day's FFMC, DMC and DC from the day before, for one station in Python; the fold is tested against it."""
    f0, p0, d0 = state
    m = 147.2 * (101 - f0) / (59.5 + f0)
    if rain > 0.5:
        r = rain - 0.5
        extra = 0.0015 * (m - 150) ** 2 * math.sqrt(r) if m > 150 else 0.0
        m = min(250.0, m + 42.5 * r * math.exp(-100 / (251 - m)) * (1 - math.exp(-6.93 / r)) + extra)
    warm = 0.18 * (21.1 - temp) * (1 - math.exp(-0.115 * rh))
    ed = 0.942 * rh**0.679 + 11 * math.exp((rh - 100) / 10) + warm
    ew = 0.618 * rh**0.753 + 10 * math.exp((rh - 100) / 10) + warm
    rate = lambda h: (0.424 * (1 - h**1.7) + 0.0694 * math.sqrt(wind) * (1 - h**8)) * 0.581 * math.exp(0.0365 * temp)
    if m > ed:
        m = ed + (m - ed) * 10 ** -rate(rh / 100)
    elif m < ew:
        m = ew - (ew - m) * 10 ** -rate((100 - rh) / 100)
    p = p0
    if rain > 1.5:
        re = 0.92 * rain - 1.27
        b = 100 / (0.5 + 0.3 * p0) if p0 <= 33 else 14 - 1.3 * math.log(p0) if p0 <= 65 else 6.2 * math.log(p0) - 17.2
        p = max(0.0, 244.72 - 43.43 * math.log(math.exp(5.6348 - p0 / 43.43) + 1000 * re / (48.77 + b * re)))
    if temp >= -1.1:
        p = tenth(p + 100 * 1.894 * (temp + 1.1) * (100 - rh) * DMC_DAY_LENGTH[month - 1] * 1e-6)
    d = max(0.0, 400 * math.log(800 / (800 * math.exp(-d0 / 400) + 3.937 * (0.83 * rain - 1.27)))) if rain > 2.8 else d0
    d = tenth(d + 0.5 * max(0.0, 0.36 * (temp + 2.8) + DC_DAY_FACTOR[month - 1]))
    return tenth(59.5 * (250 - m) / (147.2 + m)), p, d


#: Days that one inner fold collects; arrays of this length are put together in the outer one.
FOLDED = 64


def fire_weather_series(days: DataFrame, start: tuple[float, float, float] = (85.0, 6.0, 15.0), variant: str = "published") -> DataFrame:
    """Codes and indices of every station and day, by a fold over the station's days in order; it stays inside the JVM.

    A station's days (one row each) are one row. They are folded in parts, so that the results aren't copied for each day.
    """
    rows = days.groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("day", "temp", "rh", "wind_kmh", "rain"))).alias("days"))
    kind = "array<struct<day:date,wind_kmh:double,ffmc:double,dmc:double,dc:double>>"
    number = lambda c: c.cast("double")

    def state(f: Column, p: Column, d: Column, out: Column) -> Column:
        return F.struct(number(f).alias("f"), number(p).alias("p"), number(d).alias("d"), out.cast(kind).alias("out"))

    def day_step(s: Column, x: Column) -> Column:
        month = F.month(x["day"])
        f, p, d = ffmc(x["temp"], x["rh"], x["wind_kmh"], x["rain"], s["f"]), dmc(x["temp"], x["rh"], x["rain"], s["p"], month), dc(x["temp"], x["rain"], s["d"], month)
        made = F.struct(x["day"].alias("day"), number(x["wind_kmh"]).alias("wind_kmh"), number(f).alias("ffmc"), number(p).alias("dmc"), number(d).alias("dc"))
        return let(made, lambda m: state(m["ffmc"], m["dmc"], m["dc"], F.concat(s["out"], F.array(m))))

    def part_step(s: Column, first: Column) -> Column:
        part = F.slice(F.col("days"), first, F.lit(FOLDED))
        done = F.aggregate(part, state(s["f"], s["p"], s["d"], F.array()), day_step)
        return let(done, lambda e: state(e["f"], e["p"], e["d"], F.concat(s["out"], e["out"])))

    firsts = F.sequence(F.lit(1), F.size("days"), F.lit(FOLDED))
    folded = F.aggregate(firsts, state(*map(F.lit, start), F.array()), part_step)["out"]
    coded = rows.select("station_id", F.inline(folded))
    with_isi = coded.withColumn("isi", isi(F.col("wind_kmh"), F.col("ffmc"), variant)).withColumn("bui", bui(F.col("dmc"), F.col("dc")))
    return with_isi.withColumn("fwi", fwi(F.col("isi"), F.col("bui"))).drop("wind_kmh")
