"""Feature expressions: all of them built-in, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_ratio(a: Column, b: Column, instead: float = 0.1) -> Column:
    """a / b, with a zero b replaced."""
    return a / F.when(b == 0, F.lit(instead)).otherwise(b)


def row_sum(cols: Sequence[Column]) -> Column:
    """Sum over columns; missing values count as nothing."""
    return reduce(lambda x, y: x + y, [F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in cols])


def count_positive(cols: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.when((c > 0) & ~F.isnan(c.cast("double")), 1).otherwise(0) for c in cols])


def coerce_numeric(c: Column) -> Column:
    """A number from text, null if it isn't one."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def float32(c: Column) -> Column:
    return c.cast("float").cast("double")


def clamp_param(c: Column, most: float = 10, kind: str = "int") -> Column:
    """A numeric parameter from text, of kind int or double: 1 if absent, `most` at most; other text is an error."""
    return F.least(F.coalesce(c, F.lit("1")).cast(kind), F.lit(most).cast(kind))


def first_header(*names: Column) -> Column:
    """The first header that is there, of several that may carry a value (the forwarded client before the peer's address)."""
    return F.coalesce(*names)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, with fractions to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def tolerant_json(c: Column, schema: str) -> Column:
    """The parsed body; text that can't be parsed, and none at all, is an empty document."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("{}"), schema))


def echo_body(received: Column) -> Column:
    """The JSON answer that repeats what was received."""
    return F.to_json(F.struct(received.alias("received"), F.lit("ok").alias("status")))


def xorshift32(state: Column) -> Column:
    """One step of the 32-bit xorshift generator (13, 17, 5), modulo 2**31; state 0 counts as 1."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    x = F.when(state == 0, F.lit(1)).otherwise(state).cast("long").bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    x = x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)
    return x % F.lit(1 << 31).cast("long")


def engineer(df: DataFrame) -> DataFrame:
    """The six derived features where their inputs exist, text coerced to numbers, missing as 0."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    df = df.select(*[(coerce_numeric(F.col(f"`{c}`")) if c in text else F.col(f"`{c}`")).alias(c) for c in df.columns])
    have, col = set(df.columns), lambda c: F.col(f"`{c}`")
    new: dict[str, Column] = {}
    if {"Fwd IAT Mean", "Bwd IAT Mean"} <= have:
        new["IAT_ratio"] = safe_ratio(col("Fwd IAT Mean"), col("Bwd IAT Mean"))
    if {"Fwd Packet Length Mean", "Bwd Packet Length Mean"} <= have:
        new["Packet_Length_Ratio"] = safe_ratio(col("Fwd Packet Length Mean"), col("Bwd Packet Length Mean"))
    if {"Packet Length Std", "Packet Length Mean"} <= have:
        new["Packet_Size_CV"] = safe_ratio(col("Packet Length Std"), col("Packet Length Mean"))
    flags = [c for c in df.columns if "Flag" in c]
    if len(flags) > 1:
        new["Total_Flags"] = row_sum([col(c) for c in flags])
        new["Flag_Diversity"] = count_positive([col(c) for c in flags])
    rows = df.withColumns(new)
    control = ["SYN Flag Count", "FIN Flag Count", "RST Flag Count"]
    if len(flags) > 1 and set(control) <= have:
        # a step of its own: the total is computed once
        rows = rows.withColumn("Control_Flag_Ratio", safe_ratio(row_sum([col(c) for c in control]), F.col("Total_Flags"), 1.0))
    return rows.na.fill(0)
