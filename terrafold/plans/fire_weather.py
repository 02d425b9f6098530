"""Registered queries of the fire-weather codes and indices: one day from a constant state, and whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import models
from terrafold.operators import fire_series
from terrafold.plans.views import query

CODES = ("ffmc", "dmc", "dc", "isi", "bui", "fwi")


def tenth(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5::double) / 10.0::double)"


def month_value(values: tuple[float, ...]) -> str:
    return f"([{', '.join(f'{v}::double' for v in values)}])[m]"


def day_sql(source: str, keep: str) -> str:
    """SQL of a day's codes from ``source`` with ``temp``, ``rh``, ``wind``, ``rain``, ``m`` (month) and the state before (``f0``, ``p0``, ``d0``); the columns of ``keep`` go along."""
    first = f"""select {keep}, temp, rh, wind, rain, m, f0, p0, d0, 147.2::double * (101 - f0) / (59.5::double + f0) as m0, greatest(rain - 0.5::double, 1e-9::double) as rf,
  0.942::double * pow(rh, 0.679::double) + 11 * exp((rh - 100) / 10) + 0.18::double * (21.1::double - temp) * (1 - exp(-0.115::double * rh)) as ed,
  0.618::double * pow(rh, 0.753::double) + 10 * exp((rh - 100) / 10) + 0.18::double * (21.1::double - temp) * (1 - exp(-0.115::double * rh)) as ew,
  case when p0 <= 33 then 100 / (0.5::double + 0.3::double * p0) when p0 <= 65 then 14 - 1.3::double * ln(p0) else 6.2::double * ln(p0) - 17.2::double end as b,
  800 * exp(-d0 / 400) + 3.937::double * (0.83::double * rain - 1.27::double) as moist from ({source}) s0"""
    rate = lambda h: f"((0.424::double * (1 - pow({h}, 1.7::double)) + 0.0694::double * sqrt(wind) * (1 - pow({h}, 8.0::double))) * 0.581::double * exp(0.0365::double * temp))"
    second = f"""select *, case when rain > 0.5 then least(250.0::double, m0 + 42.5::double * rf * exp(-100 / (251 - m0)) * (1 - exp(-6.93::double / rf)) + case when m0 > 150 then 0.0015::double * pow(m0 - 150, 2.0::double) * sqrt(rf) else 0 end) else m0 end as mo,
  case when rain > 1.5 then greatest(0.0::double, 244.72::double - 43.43::double * ln(greatest(exp(5.6348::double - p0 / 43.43::double) + 1000 * (0.92::double * rain - 1.27::double) / (48.77::double + b * (0.92::double * rain - 1.27::double)), 1e-9::double))) else p0 end as p,
  case when rain > 2.8 then greatest(0.0::double, 400 * ln(800 / greatest(moist, 1e-9::double))) else d0 end as d from ({first}) s1"""
    third = f"""select *, case when mo > ed then ed + (mo - ed) * pow(10.0::double, -{rate("(rh / 100)")}) when mo < ew then ew - (ew - mo) * pow(10.0::double, -{rate("((100 - rh) / 100)")}) else mo end as wet from ({second}) s2"""
    codes = f"""select *, {tenth("59.5::double * (250 - wet) / (147.2::double + wet)")} as ffmc,
  case when temp < -1.1 then p else {tenth(f"p + 100 * (1.894::double * (temp + 1.1::double) * (100 - rh) * {month_value(models.DMC_DAY_LENGTH)} * 1e-6::double)")} end as dmc,
  {tenth(f"d + 0.5::double * greatest(0.0::double, 0.36::double * (temp + 2.8::double) + {month_value(models.DC_DAY_FACTOR)})")} as dc from ({third}) s3"""
    spread = f"""select *, 147.2::double * (101 - ffmc) / (59.5::double + ffmc) as fm, coalesce(0.8::double * dc / nullif(dmc + 0.4::double * dc, 0), 0) as share from ({codes}) s4"""
    indices = f"""select *, {tenth("0.208::double * 91.9::double * exp(-0.1386::double * fm) * (1 + pow(fm, 5.31::double) / 4.93e7::double) * exp(0.05039::double * wind)")} as isi,
  {tenth("greatest(0.0::double, case when dmc <= 0.4::double * dc then share * dmc else dmc - (1 - share) * (0.92::double + pow(0.0114::double * dmc, 1.7::double)) end)")} as bui from ({spread}) s5"""
    strength = f"select *, 0.1::double * isi * case when bui <= 80 then 0.626::double * pow(bui, 0.809::double) + 2 else 1000 / (25 + 108.64::double * exp(-0.023::double * bui)) end as w from ({indices}) s6"
    fwi = tenth("case when w <= 1 then w else exp(2.72::double * pow(0.434::double * ln(greatest(w, 1.0::double)), 0.647::double)) end")
    return f"select {keep}, {', '.join(CODES[:5])}, {fwi} as fwi from ({strength}) s7"


DAY = "temp, rh, wind_kmh as wind, rain, month(day) as m"


@query("d8_fire_weather_day", "weather_days", sql=day_sql(f"select station_id, day::timestamp as day, {DAY}, 85.0::double as f0, 6.0::double as p0, 15.0::double as d0 from weather_days", "station_id, day"))
def weather_day(days: DataFrame) -> DataFrame:
    """D2 to D8."""
    fw = models.fire_weather(F.col("temp"), F.col("rh"), F.col("wind_kmh"), F.col("rain"), F.month("day"))
    return days.select("station_id", F.col("day").cast("timestamp").alias("day"), fw.alias("f")).select("station_id", "day", "f.*")


SERIES = f"""with recursive d as (select station_id, day, {DAY}, row_number() over (partition by station_id order by day) as k from weather_days),
s as ({day_sql("select *, 85.0::double as f0, 6.0::double as p0, 15.0::double as d0 from d where k = 1", "station_id, day, k")}
union all {day_sql("select d.*, s.ffmc as f0, s.dmc as p0, s.dc as d0 from d join s on s.station_id = d.station_id and d.k = s.k + 1", "station_id, day, k")})
select station_id, day::timestamp as day, {", ".join(CODES)} from s"""


@query("w10_fire_weather_series", "weather_days", sql=SERIES)
def weather_series(days: DataFrame) -> DataFrame:
    return fire_series.fire_weather_series(days).withColumn("day", F.col("day").cast("timestamp"))
