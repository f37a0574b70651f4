"""H1: temperature text to kelvin, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's for equal results):
# the first number in the text, then an optional degree sign and unit letter.
TEMPERATURE_PATTERN = r"([-+]?[0-9]*\.?[0-9]+)\s*°?\s*([ckf])?"
ROOM_TEMPERATURE_K = 298.15
CELSIUS_OFFSET_K = 273.15


def parse_temperature(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Kelvin from free text such as '100 C', '250K', '32 F', 'room temperature'.

    The first number wins ('1,000 K' is 1, '1e3' is 1); a trailing c or f
    converts from Celsius or Fahrenheit, anything else is kelvin. Without a
    number, 'room' or 'ambient' gives 298.15; otherwise NULL.
    A numeric column is taken as kelvin as is (pass its ``dtype``).
    """
    c = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, T.NumericType):
        return c.cast("double")
    text = F.lower(c.cast("string"))
    number = F.regexp_extract(text, TEMPERATURE_PATTERN, 1)
    unit = F.regexp_extract(text, TEMPERATURE_PATTERN, 2)
    t = number.cast("double")
    return (
        F.when(number != "",
               F.when(unit == "c", t + F.lit(CELSIUS_OFFSET_K))
               .when(unit == "f", (t - 32) * 5 / 9 + F.lit(CELSIUS_OFFSET_K))
               .otherwise(t))
        .when(text.contains("room") | text.contains("ambient"), F.lit(ROOM_TEMPERATURE_K))
        .otherwise(F.lit(None).cast("double"))
    )
