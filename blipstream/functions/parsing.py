"""Labels, times and calibration hints in strings; all as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_label(label: Column) -> Column:
    """SRC16: struct(element, mass_number) from labels such as '24Mg | 24Mg', '56Fe.16O', 'Ag107'; null where there is none."""
    first = F.trim(F.split(F.split(label, r"\|")[0], r"\.")[0])
    mass, element = F.regexp_extract(first, r"(\d+)", 1), F.regexp_extract(first, r"([A-Z][a-z]?)", 1)
    return F.struct(F.nullif(element, F.lit("")).alias("element"), F.nullif(mass, F.lit("")).cast("int").alias("mass_number"))


def seconds_of_day(text: Column) -> Column:
    """SC16: HH:mm:ss[.fffffff] as seconds."""
    p = F.split(text, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def name_hint(name: Column, unit: str) -> Column:
    """SC20: the number before a unit in a '_'-separated block such as d60nm, c1p5ppb, n2E-3ugl; p stands for the point."""
    number = F.regexp_extract(name, rf"(?:^|_)[a-zA-Z]?(\d+(?:p\d+)?(?:E[+-]?\d+)?){unit}(?:_|$)", 1)
    return F.nullif(F.replace(number, F.lit("p"), F.lit(".")), F.lit("")).cast("double")


#: Units in file names, by what they measure, and their factors to nm, ug/l and ml/min (fixed values).
NAME_UNITS = {
    "diameter_nm": {"nm": 1.0, "um": 1e3, "µm": 1e3},
    "concentration_ug_l": {"ppt": 1e-3, "ppb": 1.0, "ppm": 1e3, "ngl": 1e-3, "ugl": 1.0, "µgl": 1.0, "mgl": 1e3},
    "flow_ml_min": {"mlmin": 1.0, "ulmin": 1e-3, "µlmin": 1e-3},
}


def name_blocks(name: Column) -> Column:
    """SC20: array of struct(prefix, value, unit) of the '_'-separated blocks of letters, a number and a unit, such as d60nm, c1p5ppb or n2E-3ugl; p before a digit is the point, blocks of any other shape are left out. Prefix and unit are in lower case."""
    shape = r"^(\p{L}*?)(\d+(?:p\d+)?)((?:[eE][+-]?\d+)?)((?![eE]).+)$"
    fitting = F.filter(F.split(name, "_"), lambda b: F.regexp_like(b, F.lit(shape)))
    number = lambda b: F.concat(F.replace(F.regexp_extract(b, shape, 2), F.lit("p"), F.lit(".")), F.regexp_extract(b, shape, 3)).try_cast("double")
    return F.transform(fitting, lambda b: F.struct(F.lower(F.regexp_extract(b, shape, 1)).alias("prefix"), number(b).alias("value"), F.lower(F.regexp_extract(b, shape, 4)).alias("unit")))


def name_conditions(blocks: Column) -> Column:
    """SC20: struct(role, sample_type, diameter_nm, concentration_ug_l, flow_ml_min) that the blocks of a name say.

    A block led by d or n makes the sample a particle calibrator, one led by c an ionic one, of several the last; q makes it
    a calibrator of either type. The last value with a unit of its kind counts.
    """
    role = F.when(F.exists(blocks, lambda b: b["prefix"].isin("d", "n", "c", "q")), "CALIBRATOR")

    def last(units: dict[str, float]) -> Column:
        def scaled(b: Column) -> Column:
            out = F.lit(None).cast("double")
            for unit, factor in units.items():
                out = F.when(b["unit"] == unit, b["value"] * factor).otherwise(out)
            return out

        found = F.filter(F.transform(blocks, scaled), lambda x: x.isNotNull())
        return F.try_element_at(found, F.lit(-1))

    kinds = F.filter(F.transform(blocks, lambda b: F.when(b["prefix"].isin("d", "n"), "PARTICLE").when(b["prefix"] == "c", "IONIC")), lambda x: x.isNotNull())
    return F.struct(role.alias("role"), F.try_element_at(kinds, F.lit(-1)).alias("sample_type"), *(last(units).alias(k) for k, units in NAME_UNITS.items()))


def java_round(x: Column) -> Column:
    """SC3."""
    return F.floor(x + 0.5)
