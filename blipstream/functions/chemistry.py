"""Isotopes, formulas and units."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element, atomic number, mass number, exact mass in u, natural abundance (IUPAC). Other tables come from load_isotopes.
ISOTOPES = [
    ("H", 1, 1, 1.00782503, 0.999885), ("C", 6, 12, 12.0, 0.9893), ("C", 6, 13, 13.00335484, 0.0107), ("N", 7, 14, 14.003074, 0.99636),
    ("O", 8, 16, 15.99491462, 0.99757), ("F", 9, 19, 18.99840316, 1.0), ("Na", 11, 23, 22.98976928, 1.0), ("Mg", 12, 24, 23.9850417, 0.7899),
    ("Mg", 12, 25, 24.98583698, 0.1), ("Mg", 12, 26, 25.98259297, 0.1101), ("Al", 13, 27, 26.98153853, 1.0), ("Si", 14, 28, 27.97692653, 0.92223),
    ("Si", 14, 29, 28.97649466, 0.04685), ("Si", 14, 30, 29.97377014, 0.03092), ("P", 15, 31, 30.973762, 1.0), ("Ti", 22, 46, 45.95262772, 0.0825),
    ("Ti", 22, 47, 46.95175879, 0.0744), ("Ti", 22, 48, 47.94794198, 0.7372), ("Ti", 22, 49, 48.94786568, 0.0541), ("Ti", 22, 50, 49.94478689, 0.0518),
    ("Cr", 24, 50, 49.94604183, 0.04345), ("Cr", 24, 52, 51.94050623, 0.83789), ("Cr", 24, 53, 52.94064815, 0.09501), ("Cr", 24, 54, 53.93887916, 0.02365),
    ("Fe", 26, 54, 53.93960899, 0.05845), ("Fe", 26, 56, 55.93493633, 0.91754), ("Fe", 26, 57, 56.93539284, 0.02119), ("Fe", 26, 58, 57.93327443, 0.00282),
    ("Ni", 28, 58, 57.93534241, 0.68077), ("Ni", 28, 60, 59.93078588, 0.26223), ("Cu", 29, 63, 62.92959772, 0.6915), ("Cu", 29, 65, 64.9277897, 0.3085),
    ("Zn", 30, 64, 63.92914201, 0.4917), ("Zn", 30, 66, 65.92603381, 0.2773), ("Ag", 47, 107, 106.9050916, 0.51839), ("Ag", 47, 109, 108.9047553, 0.48161),
    ("Ce", 58, 140, 139.9054431, 0.8845), ("Ce", 58, 142, 141.9092504, 0.11114), ("Yb", 70, 174, 173.9388664, 0.32026), ("Au", 79, 197, 196.9665688, 1.0),
]

#: Factors to the SI root of each family (fixed values).
UNITS = {
    "mass": {"kg": 1.0, "g": 1e-3, "mg": 1e-6, "ug": 1e-9, "ng": 1e-12, "pg": 1e-15, "fg": 1e-18, "ag": 1e-21},
    "size": {"m": 1.0, "mm": 1e-3, "um": 1e-6, "nm": 1e-9},
    "time": {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "min": 60.0, "h": 3600.0},
    "flow": {"m3/s": 1.0, "ml/min": 1e-6 / 60, "ul/min": 1e-9 / 60, "l/min": 1e-3 / 60},
    "concentration": {"kg/m3": 1.0, "g/l": 1.0, "mg/l": 1e-3, "ug/l": 1e-6, "ng/l": 1e-9, "ppm": 1e-3, "ppb": 1e-6, "ppt": 1e-9},
    "density": {"kg/m3": 1.0, "g/cm3": 1e3},
    "molar": {"mol": 1.0, "mmol": 1e-3, "umol": 1e-6, "nmol": 1e-9, "pmol": 1e-12, "fmol": 1e-15, "amol": 1e-18},
}


def isotopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISOTOPES, "element string, z int, mass_number int, exact_mass double, abundance double")


def load_isotopes(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: the same columns from a CSV file with a header."""
    return spark.read.csv(path, header=True, schema="element string, z int, mass_number int, exact_mass double, abundance double")


def molar_masses(table: DataFrame) -> DataFrame:
    """SC13: abundance-weighted mass of each element, and SRT4 its most abundant isotope."""
    return table.groupBy("element").agg((F.sum(F.col("exact_mass") * F.col("abundance")) / F.sum("abundance")).alias("molar_mass"), F.max_by("mass_number", "abundance").alias("most_abundant"))


def split_signal(counts: DataFrame, table: DataFrame, value: str = "counts") -> DataFrame:
    """SC13: counts of an element, split over its isotopes by abundance (shares of those listed); elements without isotopes go."""
    shares = table.join(table.groupBy("element").agg(F.sum("abundance").alias("__all")), "element").select("element", "mass_number", F.try_divide(F.col("abundance"), F.col("__all")).alias("share"))
    return counts.join(shares, "element").withColumn("isotope_counts", F.col(value) * F.col("share"))


def convert(value: Column, family: str, source: str, target: str) -> Column:
    """SC9."""
    return value * (UNITS[family][source] / UNITS[family][target])


FORMULA = re.compile(r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?|(\()|(\))(\d+(?:\.\d+)?)?")


def parse_formula(formula: str) -> dict[str, float]:
    """SC12: atoms of each element; parentheses and decimal counts are understood."""
    stack: list[dict[str, float]] = [{}]
    at = 0
    for m in FORMULA.finditer(formula):
        if m.start() != at:
            break
        at = m.end()
        if m[1]:
            stack[-1][m[1]] = stack[-1].get(m[1], 0.0) + float(m[2] or 1)
        elif m[3]:
            stack.append({})
        else:
            if len(stack) == 1:
                raise ValueError(f"not a formula: {formula!r}")
            inner = stack.pop()
            for e, n in inner.items():
                stack[-1][e] = stack[-1].get(e, 0.0) + n * float(m[5] or 1)
    if at != len(formula) or len(stack) != 1 or not formula:
        raise ValueError(f"not a formula: {formula!r}")
    return stack[0]


def mass_fraction(formula: str, element: str, masses: dict[str, float]) -> float:
    atoms = parse_formula(formula)
    return atoms.get(element, 0.0) * masses[element] / sum(n * masses[e] for e, n in atoms.items())


def mass_fractions(df: DataFrame, formula: str, element: str, masses: dict[str, float], name: str = "fraction") -> DataFrame:
    """SC12 for a column of formulas: each distinct one is parsed once, in Arrow batches on the executors; null where it isn't a formula or an element has no mass."""

    def fraction(text: str | None) -> float | None:
        try:
            return mass_fraction(text or "", element, masses)
        except (ValueError, KeyError):
            return None

    @F.pandas_udf("double")
    def run(formulas: pd.Series) -> pd.Series:
        return formulas.map(fraction)

    known = df.select(formula).distinct().withColumn(name, run(formula))
    return df.join(known, formula)


def density(text: Column, known: list[tuple[str, float]]) -> Column:
    """SC21: the density of the first substance of the caller's table that text contains, in any case."""
    return F.coalesce(*[F.when(F.lower(text).contains(k.lower()), F.lit(d)) for k, d in known])


def interpolate(x: Column, table: list[tuple[float, float]]) -> Column:
    """SC8: linear between the points of a small table (sorted by x), its ends beyond."""
    points = sorted(table)
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(points[-1][1]))
