"""Size, biomass, runoff and band expressions for trees; all coefficients are parameters with the stated defaults."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: keywords that tell a growth class, looked for in this order
PALM_WORDS = ["phoenix", "cordyline", "rhopalostylis", "washingtonia", "trachycarpus", "howea", "butia", "areca", "cycas", "livistona", "nikau", "ti kouka", "cabbage tree", "cycad"]
CONIFER_WORDS = ["pine", "fir", "spruce", "cedar", "podocarp", "rimu", "totara", "matai", "miro", "kahikatea", "kauri", "yew", "cypress", "macrocarpa", "redwood", "araucaria"]
DECIDUOUS_WORDS = ["oak", "plane", "maple", "elm", "ash", "beech", "birch", "willow", "poplar", "liquidambar", "magnolia", "ginkgo", "cherry", "apple", "pear", "robinia", "alder", "tulip", "walnut", "horse chestnut", "wisteria", "rowan", "hawthorn"]
#: fixed values per class: interception share, leaf area index, biomass a and b, root share, carbon share,
#: greatest height in m, crown growth in m2 a year
CLASSES = {
    "evergreen_broadleaf": (0.18, 4.0, 0.083, 2.46, 0.24, 0.47, 22.0, 2.2),
    "deciduous_broadleaf": (0.10, 2.5, 0.060, 2.50, 0.24, 0.47, 25.0, 2.6),
    "conifer": (0.20, 3.0, 0.053, 2.62, 0.22, 0.50, 35.0, 2.0),
    "palm_other": (0.12, 2.0, None, None, 0.20, 0.45, 14.0, 0.6),
}
#: fixed values: yearly rain in m, runoff of open and of sealed ground, sealed share if unknown, particles kg/m2/leaf area,
#: CO2 per carbon, yearly uptake share, palm biomass kg per cm
RAIN, RUNOFF_OPEN, RUNOFF_SEALED, SEALED_DEFAULT, PARTICLES, CO2, UPTAKE, PALM_KG = 1.24, 0.30, 0.90, 0.35, 0.008, 44.0 / 12.0, 0.015, 15.0


def keyword_class(text: Column, classes: Sequence[tuple[str, Sequence[str], Sequence[str]]], default: str) -> Column:
    """First class with a keyword in the text: (class, substrings, whole words); `default` if none or no text."""
    t = F.lower(text)
    out = None
    for name, parts, whole in classes:
        hit = F.lit(False)
        for p in parts:
            hit = hit | t.contains(p)
        for w in whole:
            hit = hit | t.rlike(rf"\b{w}\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def growth_class(common: Column, latin: Column) -> Column:
    text = F.concat_ws(" ", common, latin)
    return keyword_class(text, [("palm_other", PALM_WORDS, ["palm"]), ("conifer", CONIFER_WORDS, []), ("deciduous_broadleaf", DECIDUOUS_WORDS, [])], "evergreen_broadleaf")


def _by_class(c: Column, i: int) -> Column:
    out = F.lit(CLASSES["evergreen_broadleaf"][i])
    for name, v in CLASSES.items():
        if name != "evergreen_broadleaf":
            out = F.when(c == name, F.lit(v[i])).otherwise(out)
    return out


def dbh_from_height(h: Column, cls: Column, floor: float = 5.0) -> Column:
    """Trunk diameter in cm from height in m."""
    h = F.greatest(h, F.lit(0.0))
    d = F.when(cls == "palm_other", 2.0 + h * 1.2).when(cls == "conifer", h * 1.5 + h * h * 0.02).otherwise(h * 1.6 + h * h * 0.04)
    return F.greatest(d, F.lit(floor))


def dbh_from_crown(h: Column, diameter: Column, cls: Column) -> Column:
    """struct(dbh_cm, confidence): mean of the height's and the crown's estimate where both are there, 3 cm at least."""
    h, d = F.greatest(h, F.lit(0.0)), F.greatest(diameter, F.lit(0.0))
    a = dbh_from_height(h, cls, 0.0)
    b = d * F.when(cls == "conifer", 1.2).when(cls == "palm_other", 0.8).otherwise(1.7)
    both = (d > 0) & (h > 0)
    dbh = F.when(both, a * 0.5 + b * 0.5).when(h > 0, a).otherwise(b)
    return F.struct(F.greatest(dbh, F.lit(3.0)).alias("dbh_cm"), F.when(both, "modelled_medium").otherwise("modelled_low").alias("confidence"))


def biomass_kg(dbh: Column, cls: Column) -> Column:
    """Biomass above ground; 0 for no diameter."""
    b = F.when(cls == "palm_other", dbh * PALM_KG).otherwise(_by_class(cls, 2) * F.pow(dbh, _by_class(cls, 3)))
    return F.when(dbh > 0, b).otherwise(0.0)


def carbon(h: Column, cls: Column) -> Column:
    """struct of diameter, biomass above and below ground, carbon, stored and yearly CO2 from height."""
    dbh = dbh_from_height(h, cls)
    above = biomass_kg(dbh, cls)
    below = above * _by_class(cls, 4)
    c = (above + below) * _by_class(cls, 5)
    return F.struct(
        dbh.alias("dbh_cm"), above.alias("above_kg"), below.alias("below_kg"), c.alias("carbon_kg"),
        (c * CO2 / 1000).alias("co2_t"), (c * CO2 * UPTAKE / 1000).alias("co2_t_y"),
    )


def runoff(area: Column, cls: Column, sealed: Column) -> Column:
    """struct(intercepted_m3, avoided_m3): rain held by a crown, and the runoff that spares; an unknown or impossible
    sealed share counts as the default."""
    s = F.when(sealed.between(0.0, 1.0), sealed).otherwise(SEALED_DEFAULT)
    held = area * RAIN * _by_class(cls, 0)
    return F.struct(held.alias("intercepted_m3"), (held * (s * (RUNOFF_SEALED - RUNOFF_OPEN) + RUNOFF_OPEN)).alias("avoided_m3"))


def particles_kg(area: Column, cls: Column) -> Column:
    return area * _by_class(cls, 1) * PARTICLES


def banded(v: Column, bands: Sequence[tuple[float, str]], last: str, strict: bool = True) -> Column:
    """Label of the first band whose upper limit the value is below (or not above, if not strict); null stays null."""
    out = F.when(v.isNull(), None)
    for limit, label in bands:
        out = out.when(v < limit if strict else v <= limit, label)
    return out.otherwise(last)


def life_stage(h: Column, cls: Column) -> Column:
    return banded(h / _by_class(cls, 6), [(0.18, "juvenile"), (0.35, "young"), (0.60, "semi-mature"), (0.90, "mature")], "veteran")


def regrowth_years(area: Column, cls: Column) -> Column:
    return area / _by_class(cls, 7)


def replaceability(years: Column, h: Column) -> Column:
    return F.when((years >= 80) | (h >= 25), "effectively_irreplaceable").when(years >= 40, "very_high").when(years >= 15, "high").when(years >= 5, "moderate").otherwise("low")


def size_percent(h: Column, cls: Column, least: float = 5.0) -> Column:
    """Height as percent of the class's greatest, cut to one decimal; null below the least height."""
    return F.when(h >= least, F.floor(h / _by_class(cls, 6) * 1000) / 10)


def circle_diameter(area: Column) -> Column:
    return F.sqrt(area / math.pi) * 2


def suppression_radius(h: Column, base: float = 2.5, per_m: float = 0.25, least: float = 3.0, most: float = 12.0) -> Column:
    return F.least(F.greatest(h * per_m + base, F.lit(least)), F.lit(most))


def size_llr(value: Column, centre: Column, spread: Column, least: float = -6.0, most: float = 3.0, flat: float = 0.05) -> Column:
    """Log-likelihood ratio of a size under a normal law against a flat one, bounded on both sides."""
    z = (value - centre) / spread
    llr = -z * z / 2 - F.ln(spread * math.sqrt(2 * math.pi)) - math.log(flat)
    return F.greatest(F.least(llr, F.lit(most)), F.lit(least))


def green_leaf_index(r: Column, g: Column, b: Column) -> Column:
    """(2g-r-b)/(2g+r+b); null where all are 0."""
    return (g * 2 - r - b) / F.nullif(g * 2 + r + b, F.lit(0.0))


def difference_index(a: Column, b: Column) -> Column:
    """(a-b)/(a+b), as used for vegetation; null where the sum is 0."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def hue_saturation(r: Column, g: Column, b: Column) -> Column:
    """struct(hue 0..360, saturation, value) of a pixel; hue null for grey."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    safe = F.nullif(d, F.lit(0.0))
    h = F.when(hi == r, F.pmod((g - b) / safe * 60, F.lit(360.0))).when(hi == g, (b - r) / safe * 60 + 120).otherwise((r - g) / safe * 60 + 240)
    return F.struct(h.alias("hue"), F.coalesce(d / F.nullif(hi, F.lit(0.0)), F.lit(0.0)).alias("saturation"), hi.alias("value"))


def root_zone(dbh_cm: Column, crown_radius: Column, sealed: Column, factor: float = 0.12, most: float = 15.0) -> Column:
    """struct(protection_m, foraging_m, effective_m, effective_area_m2, flag): root radii of a trunk and crown.

    The protection radius is 12 diameters up to a limit; roots reach the larger of it and 1.5 crown radii; sealed
    ground takes its share of the area. Unknown sealing gives no effective area and the flag not_assessed.
    """
    rpa = F.least(dbh_cm * factor, F.lit(most))
    reach = F.greatest(rpa, crown_radius * 1.5)
    area = reach * reach * math.pi * (1 - sealed)
    return F.struct(
        rpa.alias("protection_m"), reach.alias("foraging_m"), F.sqrt(area / math.pi).alias("effective_m"), area.alias("effective_area_m2"),
        F.when(sealed.isNull(), "not_assessed").when(sealed >= 0.6, "severe").when(sealed >= 0.3, "moderate").otherwise("low").alias("flag"),
    )


def crown_radius(h: Column, rate: float = 0.45, least: float = 1.2, most: float = 5.0, unknown: float = 2.0) -> Column:
    """Radius in metres of the circular crown of a small tree; without a height that of a common one."""
    v = F.nanvl(h.cast("double"), F.lit(None).cast("double"))
    return F.when(v.isNull(), F.lit(unknown)).otherwise(F.least(F.greatest(v * rate, F.lit(least)), F.lit(most)))
