"""Package sizes: parsing, unit names and base units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of units as they are met, and their canonical form.
UNITS = {
    "oz": "oz", "ounce": "oz", "ounces": "oz",
    "fl oz": "fl oz", "fl. oz": "fl oz", "fl.oz": "fl oz", "fluid ounce": "fl oz", "fluid ounces": "fl oz",
    "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb",
    "g": "g", "gram": "g", "grams": "g",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg",
    "ml": "ml", "milliliter": "ml", "milliliters": "ml",
    "l": "l", "liter": "l", "liters": "l",
    "ct": "ct", "count": "ct", "pack": "ct", "pcs": "ct", "pieces": "ct", "piece": "ct",
    "sheets": "sheets", "sheet": "sheets", "rolls": "rolls", "roll": "rolls",
    "pt": "pt", "pint": "pt", "pints": "pt", "qt": "qt", "quart": "qt", "quarts": "qt",
    "gal": "gal", "gallon": "gal", "gallons": "gal", "sq ft": "sq ft", "sq. ft": "sq ft",
    "onz": "oz", "lbr": "lb", "grm": "g", "kgm": "kg", "mlt": "ml", "ltr": "l", "flo": "fl oz", "gll": "gal", "ptn": "pt", "qrt": "qt",
}
# Units that are converted, to what, and by which factor.
BASE_UNITS = {"kg": ("g", 1000), "l": ("ml", 1000), "lb": ("oz", 16), "gal": ("fl oz", 128), "qt": ("fl oz", 32), "pt": ("fl oz", 16)}
# The families within which sizes compare.
FAMILIES = {"g": "mass", "oz": "mass", "ml": "volume", "fl oz": "volume", "ct": "count", "sheets": "count", "rolls": "count"}
# Units whose family is known, so that sizes of a store's feed compare.
COMPARED_UNITS = ["g", "kg", "mg", "oz", "lb", "ml", "l", "fl oz", "pt", "qt", "gal", "ct", "count", "pack", "sheets", "rolls"]
# A number with a unit. The order of the names decides: "1 gal" reads as 1 g.
NUMBER_UNIT = (
    r"(?i)(\d+(?:\.\d+)?)\s*(onz|lbr|kgm|grm|mlt|ltr|flo|gll|ptn|qrt|fl\.?\s*oz|fluid\s+ounces?|oz|ounces?|lbs?|pounds?|kg|kilograms?|g|grams?|ml|milliliters?|"
    r"l|liters?|ct|count|pack|pcs|pieces?|sheets?|rolls?|sq\.?\s*ft|pt|pints?|qt|quarts?|gal|gallons?)"
)
POUNDS_OUNCES = r"(?i)(\d+(?:\.\d+)?)\s*(?:lb|lbs|pound|pounds)\s+(\d+(?:\.\d+)?)\s*(?:oz|ounce|ounces)"
#: The same, but the unit must end where the word does.
STRICT_NUMBER_UNIT = NUMBER_UNIT + r"(?![A-Za-z])"


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def normalize_unit(unit: Column) -> Column:
    """Canonical unit; null and empty are oz, an unknown name stays as it is."""
    key = F.trim(F.regexp_replace(F.lower(unit), r"\s+", " "))
    found = F.coalesce(_lookup(UNITS, key), _lookup(UNITS, F.regexp_replace(key, "s+$", "")), key)
    return F.when(unit.isNull() | (unit == ""), F.lit("oz")).otherwise(found)


def _single(text: Column, pattern: str) -> Column:
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number != "", F.struct(number.cast("double").alias("value"), normalize_unit(F.regexp_extract(text, pattern, 2)).alias("unit")))


def parse_package_weight(text: Column, strict: bool = False) -> Column:
    """struct<value, unit> of a free-text size, null if there is none.

    Pounds with ounces add up to ounces; of "a / b" the first part counts if it
    parses, else the second; then what stands before a parenthesis; then the first
    number with a unit.
    """
    pattern = STRICT_NUMBER_UNIT if strict else NUMBER_UNIT
    text = F.trim(text)
    pounds, ounces = F.regexp_extract(text, POUNDS_OUNCES, 1), F.regexp_extract(text, POUNDS_OUNCES, 2)
    compound = F.when(pounds != "", F.struct((pounds.cast("double") * 16 + ounces.cast("double")).alias("value"), F.lit("oz").alias("unit")))
    parts = F.split(text, "/", 2)
    slash = F.when(text.contains("/"), F.coalesce(_single(parts[0], pattern), _single(parts[1], pattern)))
    paren = F.when(text.contains("("), _single(F.split(text, r"\(", 2)[0], pattern))
    return F.coalesce(compound, slash, paren, _single(text, pattern))


def convert_to_base(value: Column, unit: Column) -> Column:
    """struct<value, unit> in the unit's base; other units stay."""
    factor = _lookup({k: float(v[1]) for k, v in BASE_UNITS.items()}, unit)
    base = _lookup({k: v[0] for k, v in BASE_UNITS.items()}, unit)
    return F.struct((value * F.coalesce(factor, F.lit(1.0))).alias("value"), F.coalesce(base, unit).alias("unit"))


def size_key(value: Column, unit: Column) -> Column:
    """struct<value, unit> by which sizes are equal: rounded to 4 places in the base unit; null without a size or for a unit of no family."""
    name = F.lower(F.trim(unit))
    base = convert_to_base(value, name)
    return F.when(value.isNotNull() & name.isin(COMPARED_UNITS), F.struct(F.round(base["value"], 4).alias("value"), base["unit"].alias("unit")))


def unit_family(unit: Column) -> Column:
    return _lookup(FAMILIES, unit)
