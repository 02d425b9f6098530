"""Environmental models as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of halves upward (also below zero)."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a fixed table, ``default`` on a miss or null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def banded(x: Column, steps: tuple[tuple[float, str], ...], above: str, null: str | None = None) -> Column:
    """The first label whose bound is above x, else ``above``."""
    when = reduce(lambda w, s: w.when(x < s[0], s[1]), steps[1:], F.when(x < steps[0][0], steps[0][1]))
    return F.when(x.isNull(), null).otherwise(when.otherwise(above))


# Weights and factors of the models.
FUEL_WEIGHTS = {"chaparral": 0.95, "grassland": 0.8, "shrubland": 0.85, "mixed_forest": 0.7, "conifer_forest": 0.75, "deciduous_forest": 0.5, "wetland": 0.1, "agricultural": 0.4, "urban": 0.2, "bare": 0.05}
COVER_FACTORS = {"forest": 0.001, "woodland": 0.003, "pasture": 0.01, "grassland": 0.02, "cover_cropping": 0.05, "silvopasture": 0.008, "cropland": 0.2, "bare": 1.0, "shrubland": 0.05, "wetland": 0.001, "urban": 0.01}
CARBON_MULTIPLIERS = {"reforestation": 1.5, "silvopasture": 1.2, "cover_cropping": 0.8, "biochar": 2.0, "pasture": 0.6, "cropland": 0.4, "grassland": 0.7, "forest": 0.3, "bare": 1.0}
#: strategy: water stress, soil health, fire risk, vegetation degradation, community demand
STRATEGY_WEIGHTS = {"keyline": (0.4, 0.2, 0.1, 0.2, 0.1), "silvopasture": (0.2, 0.3, 0.2, 0.2, 0.1), "reforestation": (0.15, 0.25, 0.25, 0.3, 0.05), "biochar": (0.1, 0.45, 0.1, 0.2, 0.15), "water_harvesting": (0.5, 0.15, 0.05, 0.15, 0.15), "cover_cropping": (0.2, 0.4, 0.05, 0.25, 0.1)}
CONDITION_STRESS = {"above_normal": 20, "normal": 35, "below_normal": 55, "low": 70, "critically_low": 90, "unknown": 50}
DROUGHT_LABELS = {0: "D0 Abnormally Dry", 1: "D1 Moderate Drought", 2: "D2 Severe Drought", 3: "D3 Extreme Drought", 4: "D4 Exceptional Drought"}
DROUGHT_WORDINGS = {
    "layer": tuple(DROUGHT_LABELS.values()),
    "record": ("D0 (Abnormally Dry)", "D1 (Moderate Drought)", "D2 (Severe Drought)", "D3 (Extreme Drought)", "D4 (Exceptional Drought)"),
    "interface": ("D0 - Abnormally Dry", "D1 - Moderate", "D2 - Severe", "D3 - Extreme", "D4 - Exceptional"),
    "export": ("None", "D0 Abnormally Dry", "D1 Moderate", "D2 Severe", "D3 Extreme", "D4 Exceptional"),
}
WATER_BANDS = ((-0.2, "Severe water stress"), (0.0, "High water stress"), (0.2, "Moderate stress"), (0.4, "Adequate moisture"), (0.6, "High moisture"))
SEVERITY_LABELS = {1: "unburned", 2: "low", 3: "moderate", 4: "high", 5: "increased_greenness"}
DMC_DAY_LENGTH = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_DAY_FACTOR = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)


def fire_risk(vegetation: Column, slope: Column, aspect: Column, humidity: Column, wind_ms: Column, fuel: Column | None = None) -> Column:
    """0 to 100 from fuel, slope, aspect, dryness and wind."""
    load = lookup(vegetation, FUEL_WEIGHTS, 0.5) if fuel is None else F.coalesce(fuel, lookup(vegetation, FUEL_WEIGHTS, 0.5))
    parts = (
        load * 100 * 0.3, F.least(F.lit(100.0), slope / 45 * 100) * 0.2, (F.cos(F.radians(aspect) - F.lit(3.141592653589793)) + 1) / 2 * 100 * 0.1,
        F.greatest(F.lit(0.0), 100 - humidity) * 0.25, F.least(F.lit(100.0), wind_ms / 30 * 100) * 0.15,
    )
    return half_up(clamp(reduce(lambda a, b: a + b, parts), 0.0, 100.0))


def isi(wind: Column, ffmc: Column, variant: str = "published") -> Column:
    """Initial spread index; ``as_written`` applies 0.208 twice."""
    fm = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    ff = (91.9 if variant == "published" else 19.115) * F.exp(-0.1386 * fm) * (1 + F.pow(fm, 5.31) / 4.93e7)
    return half_up(0.208 * ff * F.exp(0.05039 * wind), 1)


def bui(dmc: Column, dc: Column) -> Column:
    """Buildup index; 0 when both codes are 0."""
    share = F.coalesce(F.try_divide(0.8 * dc, dmc + 0.4 * dc), F.lit(0.0))
    low, high = share * dmc, dmc - (1 - share) * (0.92 + F.pow(0.0114 * dmc, 1.7))
    return half_up(F.greatest(F.lit(0.0), F.when(dmc <= 0.4 * dc, low).otherwise(high)), 1)


def fwi(isi_: Column, bui_: Column) -> Column:
    """Fire weather index."""
    f = F.when(bui_ <= 80, 0.626 * F.pow(bui_, 0.809) + 2).otherwise(1000 / (25 + 108.64 * F.exp(-0.023 * bui_)))
    b = 0.1 * isi_ * f
    return half_up(F.when(b <= 1, b).otherwise(F.exp(2.72 * F.pow(0.434 * F.log(F.greatest(b, F.lit(1.0))), 0.647))), 1)


def ffmc(temp: Column, rh: Column, wind: Column, rain: Column, before: Column) -> Column:
    """Fine fuel moisture code."""
    m0 = 147.2 * (101 - before) / (59.5 + before)
    rf = F.greatest(rain - 0.5, F.lit(1e-9))
    wet = m0 + 42.5 * rf * F.exp(-100 / (251 - m0)) * (1 - F.exp(-6.93 / rf))
    wet = F.least(F.lit(250.0), wet + F.when(m0 > 150, 0.0015 * F.pow(m0 - 150, 2.0) * F.sqrt(rf)).otherwise(0.0))
    mo = F.when(rain > 0.5, wet).otherwise(m0)
    warm = 0.18 * (21.1 - temp) * (1 - F.exp(-0.115 * rh))
    ed = 0.942 * F.pow(rh, 0.679) + 11 * F.exp((rh - 100) / 10) + warm
    ew = 0.618 * F.pow(rh, 0.753) + 10 * F.exp((rh - 100) / 10) + warm
    rate = lambda h: (0.424 * (1 - F.pow(h, 1.7)) + 0.0694 * F.sqrt(wind) * (1 - F.pow(h, 8.0))) * 0.581 * F.exp(0.0365 * temp)
    dry = ed + (mo - ed) * F.pow(F.lit(10.0), -rate(rh / 100))
    damp = ew - (ew - mo) * F.pow(F.lit(10.0), -rate((100 - rh) / 100))
    m = F.when(mo > ed, dry).when(mo < ew, damp).otherwise(mo)
    return half_up(59.5 * (250 - m) / (147.2 + m), 1)


def dmc(temp: Column, rh: Column, rain: Column, before: Column, month: Column) -> Column:
    """D3: duff moisture code."""
    slope = F.when(before <= 33, 100 / (0.5 + 0.3 * before)).when(before <= 65, 14 - 1.3 * F.log(F.greatest(before, F.lit(1e-9)))).otherwise(6.2 * F.log(F.greatest(before, F.lit(1e-9))) - 17.2)
    re = 0.92 * rain - 1.27
    mr = 20 + F.exp(5.6348 - before / 43.43) + 1000 * re / (48.77 + slope * re)
    pr = F.when(rain > 1.5, F.greatest(F.lit(0.0), 244.72 - 43.43 * F.log(F.greatest(mr - 20, F.lit(1e-9))))).otherwise(before)
    k = 1.894 * (temp + 1.1) * (100 - rh) * F.element_at(F.array(*map(F.lit, DMC_DAY_LENGTH)), month.cast("int")) * 1e-6
    return F.when(temp < -1.1, pr).otherwise(half_up(pr + 100 * k, 1))


def dc(temp: Column, rain: Column, before: Column, month: Column) -> Column:
    """Drought code."""
    moist = 800 * F.exp(-before / 400) + 3.937 * (0.83 * rain - 1.27)
    dr = F.when(rain > 2.8, F.greatest(F.lit(0.0), 400 * F.log(800 / F.greatest(moist, F.lit(1e-9))))).otherwise(before)
    v = 0.36 * (temp + 2.8) + F.element_at(F.array(*map(F.lit, DC_DAY_FACTOR)), month.cast("int"))
    return half_up(dr + 0.5 * F.greatest(F.lit(0.0), v), 1)


def fire_weather(temp: Column, rh: Column, wind: Column, rain: Column, month: Column, state: tuple[float, float, float] = (85.0, 6.0, 15.0), variant: str = "published") -> Column:
    """One day's indices from a constant start state."""
    a, b, c = ffmc(temp, rh, wind, rain, F.lit(state[0])), dmc(temp, rh, rain, F.lit(state[1]), month), dc(temp, rain, F.lit(state[2]), month)
    i, u = isi(wind, a, variant), bui(b, c)
    return F.struct(a.alias("ffmc"), b.alias("dmc"), c.alias("dc"), i.alias("isi"), u.alias("bui"), fwi(i, u).alias("fwi"))


def composite_risk(risk: Column, fwi_: Column) -> Column:
    """Fire risk and fire weather in one score."""
    return half_up(0.6 * risk + 0.4 * F.least(F.lit(100.0), fwi_ / 50 * 100))


def erodibility(organic_carbon: Column, bulk_density: Column) -> Column:
    """Soil erodibility factor."""
    return clamp(0.1 + F.greatest(F.lit(0.0), 1 - organic_carbon / 20) * 0.4 + F.least(F.lit(1.0), bulk_density / 1.5) * 0.15, 0.02, 0.69)


def slope_factor(degrees: Column) -> Column:
    """Slope length and steepness factor."""
    ls = F.pow(degrees / 22.13, 0.6) * F.pow(F.sin(F.radians(degrees)) / 0.0896, 1.3)
    return F.when(degrees <= 0, F.lit(0.0)).otherwise(F.least(ls, F.lit(50.0)))


def erosion_score(organic_carbon: Column, bulk_density: Column, degrees: Column, cover: Column) -> Column:
    """0 to 100."""
    usle = erodibility(organic_carbon, bulk_density) * slope_factor(degrees) * lookup(cover, COVER_FACTORS, 0.1)
    return half_up(clamp(usle / 0.01 * 10, 0.0, 100.0))


def erosion_class(score: Column) -> Column:
    return banded(score, ((10, "very_low"), (30, "low"), (55, "moderate"), (75, "high")), "very_high")


def carbon_potential(organic_carbon: Column, bulk_density: Column, cover: Column, rain_mm: Column) -> Column:
    """Yearly gain, years to saturation and confidence."""
    deficit = F.greatest(F.lit(0.0), 6.5 - organic_carbon / 10)
    wet = F.when(rain_mm < 400, 0.4).when(rain_mm < 800, 0.4 + (rain_mm - 400) / 400 * 0.6).when(rain_mm <= 2000, 1.0).otherwise(F.greatest(F.lit(0.6), 1.0 - (rain_mm - 2000) / 2000 * 0.4))
    gain = deficit * 0.3 * lookup(cover, CARBON_MULTIPLIERS, 1.0) * wet
    years = F.when(gain > 0, F.least(half_up(F.try_divide(deficit, gain / 10)), F.lit(100.0))).otherwise(100.0)
    sure = F.when((organic_carbon > 0) & (bulk_density > 0), F.when(rain_mm > 0, "high").otherwise("medium")).otherwise("low")
    return F.struct(organic_carbon.alias("current_oc"), half_up(gain, 2).alias("gain"), years.alias("years"), sure.alias("confidence"))


def suitability(intervention: Column, ph: Column, organic_carbon: Column, nitrogen: Column, bulk_density: Column, cec: Column) -> Column:
    """Score of an intervention by soil thresholds."""
    oc = organic_carbon / 10
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    score = (
        F.when(intervention == "reforestation", 40 + pick(oc < 2, 30, 10) + pick((ph > 5.5) & (ph < 7.5), 20, 0))
        .when(intervention == "silvopasture", 30 + pick(oc > 1.5, 25, 10) + pick((ph > 5.5) & (ph < 7.0), 25, 10) + pick(cec > 10, 10, 0))
        .when(intervention == "cover_cropping", 55 + pick(oc < 1.5, 20, 5) + pick(nitrogen < 1, 15, 0))
        .when(intervention == "biochar", 30 + F.when(oc < 1, 40).when(oc < 2, 20).otherwise(5) + pick(cec < 10, 20, 5))
        .when(intervention == "keyline", 40 + pick((bulk_density > 0.8) & (bulk_density < 1.4), 30, 10) + pick(ph > 5.5, 15, 0))
        .otherwise(50)
    )
    return clamp(score, 0, 100)


def soil_score(organic_carbon: Column) -> Column:
    """Degradation from organic carbon."""
    return F.when(organic_carbon <= 0, 90.0).when(organic_carbon >= 30, 10.0).otherwise(half_up(100 - organic_carbon / 30 * 90))


def drought_stress(dm: Column) -> Column:
    """Stress from the drought class, null without one."""
    return half_up(40.0 + 15 * dm)


def gauge_stress(percentile: Column, condition: Column) -> Column:
    """Stress from a gauge."""
    return F.coalesce(half_up(100.0 - percentile), lookup(condition, CONDITION_STRESS, 50).cast("double"))


def factors(lat: Column, lon: Column, soil: Column, drought: Column, gauge: Column) -> Column:
    """The five input factors, each from its source or else from the place."""
    west = clamp((-lon - 100) / 25, 0.0, 1.0)
    water = F.when(drought.isNotNull() & gauge.isNotNull(), half_up(drought * 0.6 + gauge * 0.4)).otherwise(F.coalesce(drought, gauge, half_up(30 + west * 50 + (F.sin(lat * 0.3) + 1) * 10)))
    soil_ = F.coalesce(soil, F.least(F.lit(90.0), 40 + F.abs(lat - 37) / 20 * 20 + F.abs(lon + 115) / 30 * 15))
    fire = half_up(25 + F.greatest(F.lit(0.0), (36 - lat) * 1.5) + F.greatest(F.lit(0.0), (-lon - 117) * 2) + (F.cos(lon * 0.15) + 1) * 8)
    vegetation = half_up(20 + soil_ * 0.4 + (F.sin(lat * 0.2 + lon * 0.1) + 1) * 10)
    demand = half_up(30 + (F.cos(lat * 0.5) + 1) * 20)
    names = ("water_stress", "soil_health", "fire_risk", "vegetation", "demand")
    return F.struct(*(clamp(x, 0.0, 100.0).alias(n) for n, x in zip(names, (water, soil_, fire, vegetation, demand), strict=True)))


def strategy_scores(f: Column) -> Column:
    """Array of (ordinal, strategy, score), a row for each strategy."""
    names = ("water_stress", "soil_health", "fire_risk", "vegetation", "demand")
    score = lambda w: half_up(clamp(reduce(lambda a, b: a + b, [f[n] * x for n, x in zip(names, w, strict=True)]), 0.0, 100.0))
    return F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(s).alias("strategy"), score(w).alias("score")) for k, (s, w) in enumerate(STRATEGY_WEIGHTS.items())))


def top_reasons(f: Column, strategy: Column) -> Column:
    """Names of the (at most three) triggered factors with the largest weighted share, best first."""
    limits = {"water_stress": 60, "soil_health": 50, "fire_risk": 55, "vegetation": 55, "demand": 40}
    parts = [F.struct((-f[n] * lookup(strategy, {s: w[k] for s, w in STRATEGY_WEIGHTS.items()}, 0.0)).alias("rank"), F.lit(k).alias("k"), F.lit(n).alias("name"), (f[n] > limit).alias("on")) for k, (n, limit) in enumerate(limits.items())]
    best = F.slice(F.array_sort(F.filter(F.array(*parts), lambda x: x["on"])), 1, 3)
    return F.when(F.size(best) > 0, F.transform(best, lambda x: x["name"])).otherwise(F.array(F.lit("applicable")))


def data_confidence(soil: Column, weather: Column) -> Column:
    """D20."""
    return F.when(soil & weather, "high").when(soil | weather, "medium").otherwise("low")


def streamflow_condition(p: Column) -> Column:
    """D21."""
    return F.when(p.isNull(), "unknown").when(p > 75, "above_normal").when(p >= 25, "normal").when(p >= 10, "below_normal").when(p >= 5, "low").otherwise("critically_low")


def qualifier_trend(codes: Column) -> Column:
    """D22."""
    return F.when(F.exists(codes, lambda c: F.lower(c) == "e"), "declining").otherwise("stable")


def drainage_class(raw: Column) -> Column:
    """Specific wordings before general ones."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    order = (("excessively", "excessive"), ("moderately well", "moderately_well"), ("somewhat poorly", "somewhat_poorly"), ("very poorly", "very_poorly"), ("poorly", "poorly"), ("well", "well"))
    return reduce(lambda w, s: w.when(text.contains(s[0]), s[1]), order[1:], F.when(text.contains(order[0][0]), order[0][1])).otherwise("unknown")


def burn_severity(code: Column) -> Column:
    """D25."""
    return lookup(code.cast("int"), SEVERITY_LABELS, "unburned")


def drought_label(dm: Column, wording: str = "layer") -> Column:
    """The text of a drought class, in the wording of map layers, records, the programming interface or exports.

    Exports count classes from 1, with "None" for 0 and less and the strongest text above; the others have no text for a
    class outside 0 to 4: layers say "None", records null, the interface the letter and number.
    """
    names = dict(enumerate(DROUGHT_WORDINGS[wording]))
    if wording == "export":
        return lookup(F.least(F.greatest(dm.cast("int"), F.lit(0)), F.lit(5)), names, "None")
    if wording == "interface":
        return F.when(dm.isNotNull(), F.coalesce(lookup(dm.cast("int"), names, None), F.concat(F.lit("D"), dm.cast("int").cast("string"))))
    return lookup(dm.cast("int"), names, "None" if wording == "layer" else None)


def water_label(value: Column) -> Column:
    """Band of a water index."""
    return banded(value, WATER_BANDS, "Water body")


def point_risk(risk: Column, fwi_: Column, code: Column) -> Column:
    """The composite score, and how sure it is: by a known vegetation code and a high fire-weather index."""
    sure = F.when(code > 0, F.when(fwi_ > 30, "high").otherwise("medium")).otherwise("low")
    return F.struct(composite_risk(risk, fwi_).alias("score"), sure.alias("confidence"))


def badges(risk: Column, dm: Column, percentile: Column, fires: Column) -> Column:
    """Words and colours for a region's fire risk, drought class, streamflow percentile and number of fires."""
    colours = ("red", "yellow", "green")

    def badge(at_red: Column, at_yellow: Column, words: tuple[str, str, str]) -> Column:
        pick = lambda names: F.when(at_red, names[0]).when(at_yellow, names[1]).otherwise(names[2])
        return F.concat(pick(words), F.lit("/"), pick(colours))

    return F.struct(
        badge(risk >= 60, risk >= 30, ("High", "Moderate", "Low")).alias("risk"), badge(dm >= 3, dm >= 2, ("Severe", "Moderate", "Normal")).alias("drought"),
        badge(percentile <= 20, percentile <= 40, ("Critically Low", "Below Normal", "Normal")).alias("streamflow"), badge(fires > 20, fires > 5, ("High", "Elevated", "Normal")).alias("fires"),
    )


def growing_system(scarcity: Column, anomalies: Column, fire: Column) -> Column:
    """D27."""
    return F.when(scarcity > 0.7, "Hydroponics").when((scarcity > 0.5) & (anomalies == 0), "Aquaponics").when(fire > 0.6, "Silvopasture").otherwise("Agroforestry")


def risk_trend(risk: Column, dm: Column) -> Column:
    """D28."""
    return F.when((risk > 50) | (dm >= 3), "worsening").when((risk < 20) & (dm <= 1), "improving").otherwise("stable")


def distance_severity(km: Column) -> Column:
    """D30."""
    return F.when(km < 10, "critical").when(km < 30, "warning").otherwise("info")


def ndvi_value(raw: Column) -> Column:
    """S20."""
    return F.when(raw >= -1000, raw / 10000)


def osm_height(tags: Column) -> Column:
    """Leading number of height, else levels times 3.5."""
    return F.coalesce(F.regexp_extract(F.try_element_at(tags, F.lit("height")), r"^\s*(\d+\.?\d*)", 1).try_cast("double"), F.try_element_at(tags, F.lit("building:levels")).try_cast("double") * 3.5)


def piecewise(x: Column, stops: tuple[tuple[float, float], ...]) -> Column:
    """Linear between stops, constant beyond."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
        out = F.when(x < x1, y0 + (F.greatest(x, F.lit(float(x0))) - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def wind_class(ms: Column) -> Column:
    """D37."""
    return banded(ms, ((5, "calm"), (10, "breeze"), (20, "strong")), "storm")


def wind_alert(ms: Column) -> Column:
    """Above 50 km/h."""
    return ms * 3.6 > 50
