"""One canonical text per value, so that 1, 1.0 and '1' are the same value.

The form is ``n:<number>`` for anything numeric, ``s:<text>`` for other values,
``b:<hex>`` for binary, ``j:<JSON>`` of such texts for nested values, and NULL for NULL. It is what results are grouped and hashed by:
Spark hashes 1, 1L and 1.0 differently, but equal canonical texts hash alike.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of any script, spelled out: the Unicode flag would slow every match down.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_S = "[" + _SPACES + "]*"
_DIGITS = "[0-9]++(?:_[0-9]++)*+"
_PLAIN = r"\A(?:0|-?[1-9][0-9]*)\z"
_INTEGER = rf"\A{_S}[+-]?{_DIGITS}{_S}\z"
_NUMBER = (rf"\A{_S}[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf(?:inity)?)){_S}\z")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` branches. It keeps
    large expressions out of the generated code of a stage, which has to stay small to be compiled."""
    return F.transform(F.array(value), use)[0]


def _digits_of(d: Column) -> Column:
    """All digits of a whole double from 2^63 up to 10^38. A cast to decimal goes through the shortest print of a double and
    loses the last ones; parts by powers of two are exact."""
    size = F.abs(d)
    high = F.floor(size / 2.0**64)
    low = size - high.cast("double") * 2.0**64
    middle = F.floor(low / 2.0**32)
    last = (low - middle.cast("double") * 2.0**32).cast("bigint")
    power = lambda n: F.lit(Decimal(2**n))
    whole = high.cast("decimal(20,0)") * power(64) + middle.cast("decimal(20,0)") * power(32) + last.cast("decimal(20,0)")
    return F.concat(F.when(d < 0, "-").otherwise(""), whole.cast("decimal(38,0)").cast("string"))


def _big_digits_of(d: Column) -> Column:
    """All digits of a double from 10^38 on. It is a whole number below 2^54 times a power of two; that product is made in limbs
    of nine digits, 29 bits at a time, so no limb leaves 64 bits."""
    size, limb = F.abs(d), F.lit(10**9).cast("bigint")
    power = (F.floor(F.log2(size)) - 53).cast("int")
    whole = (size / F.pow(F.lit(2.0), power)).cast("bigint")
    div = lambda a, b: F.call_function("div", a, b)
    start = F.array(whole % limb, div(whole, limb) % limb, div(div(whole, limb), limb))
    times = F.concat(F.array_repeat(F.lit(29), div(power, F.lit(29)).cast("int")), F.array(power % 29))

    def multiplied(limbs: Column, bits: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            v = x * F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) + acc["carry"]
            return F.struct(div(v, limb).alias("carry"), F.array_append(acc["out"], v % limb).alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(limbs, zero, step, lambda acc: F.when(acc["carry"] > 0, F.array_append(acc["out"], acc["carry"])).otherwise(acc["out"]))

    limbs = F.aggregate(times, start, multiplied)
    digits = F.array_join(F.reverse(F.transform(limbs, lambda x: F.lpad(x.cast("string"), 9, "0"))), "")
    return F.concat(F.when(d < 0, "-").otherwise(""), F.ltrim(digits, F.lit("0")))


def _from_double(d: Column) -> Column:
    """Whole doubles print like integers, with all digits."""
    whole = F.rint(d) == d
    return (F.when(whole & (F.abs(d) < F.lit(2.0**63)), d.cast("bigint").cast("string"))
            .when(whole & (F.abs(d) < F.lit(1e38)), _digits_of(d))
            .when(whole & (F.abs(d) < F.lit(float("inf"))), _big_digits_of(d))
            .otherwise(d.cast("string")))


def _from_text(t: Column, digits: int | None) -> Column:
    def number(d: Column) -> Column:
        return F.concat(F.lit("n:"), _from_double(d if digits is None else F.round(d, digits)))

    bare = F.translate(t, _SPACES + "_+", "")
    integer = F.regexp_replace(bare, r"^(-?)0+(?=[0-9])", "$1")
    text = F.concat(F.lit("s:"), t)
    return (F.when(~t.rlike(_NUMBER), text)
            .when(t.rlike(_PLAIN), F.concat(F.lit("n:"), t))
            .when(t.rlike(_INTEGER), let(integer, lambda i: F.when(i == "-0", F.lit("n:0")).otherwise(F.concat(F.lit("n:"), i))))
            .otherwise(let(F.translate(t, _SPACES + "_", "").try_cast("double"), number)))


def _from_decimal(c: Column, dtype: T.DecimalType, digits: int | None) -> Column:
    if digits is not None:
        c = F.round(c, digits)
    if dtype.scale == 0:
        return c.cast("string")
    d = c.cast("double")
    exact = F.regexp_replace(c.cast("string"), r"0+$", "")
    return (F.when(c == F.floor(c), c.try_cast("decimal(38,0)").cast("string"))
            .when(d.try_cast(dtype) == c, d.cast("string"))
            .otherwise(exact))


def _nested(col: Column, dtype: T.DataType, digits: int | None) -> Column:
    """Arrays in their order, structs by their field names, maps by sorted keys: equal values have equal texts."""
    if isinstance(dtype, T.ArrayType):
        return F.to_json(F.transform(col, lambda x: normalize(x, dtype.elementType, digits)))
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.array(normalize(e["key"], dtype.keyType, digits), normalize(e["value"], dtype.valueType, digits))
        return F.to_json(F.array_sort(F.transform(F.map_entries(col), entry)))
    fields = [x for f in dtype.fields for x in (F.lit(f.name), normalize(col.getField(f.name), f.dataType, digits))]
    return F.when(col.isNotNull(), F.to_json(F.array(*fields) if fields else F.array().cast("array<string>")))


def normalize(col: Column, dtype: T.DataType, digits: int | None = None) -> Column:
    """Canonical text of ``col``; ``digits`` rounds numbers first, for comparison with tolerance."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return let(col, lambda t: _from_text(t, digits))
    if isinstance(dtype, T.BooleanType):
        return F.concat(F.lit("n:"), col.cast("int").cast("string"))
    if isinstance(dtype, T.DecimalType):
        return F.concat(F.lit("n:"), let(col, lambda c: _from_decimal(c, dtype, digits)))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = col.cast("double")
        return F.concat(F.lit("n:"), let(d if digits is None else F.round(d, digits), _from_double))
    if isinstance(dtype, T.IntegralType):
        return F.concat(F.lit("n:"), col.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("b:"), F.hex(col))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.concat(F.lit("j:"), _nested(col, dtype, digits))
    if isinstance(dtype, T.VariantType):
        return F.concat(F.lit("s:"), F.to_json(col))
    return F.concat(F.lit("s:"), col.cast("string"))


def normalize_frame(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Every column in canonical form, named by position; column names carry no meaning."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[normalize(F.col(f.name), f.dataType, digits).alias(f.name) for f in plain.schema.fields])
