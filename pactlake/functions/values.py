"""One view on JSON values, whether they stand in typed columns or in VARIANT columns."""

from __future__ import annotations

import json
from decimal import Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Guard = bool | Column


def all_of(*parts: Guard) -> Guard:
    """Conjunction that folds constants."""
    cols = [p for p in parts if p is not True]
    if any(p is False for p in cols):
        return False
    out: Guard = True
    for c in cols:
        out = c if out is True else out & c
    return out


def any_of(*parts: Guard) -> Guard:
    return negate(all_of(*(negate(p) for p in parts)))


def negate(part: Guard) -> Guard:
    return not part if isinstance(part, bool) else ~part


def implies(guard: Guard, then: Guard) -> Guard:
    return any_of(negate(guard), then)


def col_of(part: Guard) -> Column:
    return F.lit(part) if isinstance(part, bool) else F.coalesce(part, F.lit(False))


def column(part: Guard) -> Column:
    """As a Column, NULL kept: NULL stands for a value that was not looked at deep enough to decide."""
    return F.lit(part) if isinstance(part, bool) else part


#: Numbers of up to 20 digits before and 18 after the point are compared exactly; others as doubles.
EXACT = "decimal(38,18)"


def exact_literal(n: int | float) -> Column | None:
    """A number of a contract as an exact decimal, or None if it has too many digits."""
    d = Decimal(n) if isinstance(n, int) else Decimal(repr(n))
    if not d.is_finite() or abs(d) >= 10**20 or d != d.quantize(Decimal(1).scaleb(-18), context=Context(prec=400)):
        return None
    return F.lit(f"{d:f}").cast(EXACT)


def plain_json(x):
    """The value with whole numbers written without a fraction, as equality of JSON wants it."""
    if isinstance(x, dict):
        return {k: plain_json(v) for k, v in x.items()}
    if isinstance(x, list):
        return [plain_json(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def nearly_whole(ratio: Column) -> Column:
    return F.abs(ratio - F.round(ratio)) <= 4 * 2.0**-52 * F.greatest(F.abs(ratio), F.lit(1.0))


class Typed:
    """A value in a typed column; SQL NULL is a missing value, which has no type."""

    def __init__(self, col: Column, kind: T.DataType) -> None:
        self.col, self.dtype = col, kind

    def is_type(self, name: str) -> Guard:
        numeric = isinstance(self.dtype, T.NumericType)
        if name == "integer" and numeric:
            whole = isinstance(self.dtype, T.IntegralType)
            return self.col.isNotNull() if whole else F.coalesce(self.col % 1 == 0, F.lit(False))
        kinds = {"string": T.StringType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}
        fits = numeric if name == "number" else name in kinds and isinstance(self.dtype, kinds[name])
        return self.col.isNotNull() if fits else False

    def text(self) -> Column:
        return self.col

    def number(self) -> Column:
        return self.col

    def compared(self, test, n: int | float) -> Column:
        """test(number, bound); exact where the column's type is."""
        return col_of(test(self.col, F.lit(n)))

    def multiple(self, step: int | float) -> Column:
        if isinstance(step, int) or step.is_integer():
            return col_of((self.col % int(step)) == 0)
        return col_of(nearly_whole(self.col / float(step)))

    def equals(self, other) -> Guard:
        if isinstance(other, bool):
            return col_of(self.col == other) if isinstance(self.dtype, T.BooleanType) else False
        if isinstance(other, (int, float)):
            return col_of(self.col == other) if isinstance(self.dtype, T.NumericType) else False
        if isinstance(other, str):
            return col_of(self.col == other) if isinstance(self.dtype, T.StringType) else False
        if other is None:
            return False
        return col_of(F.to_json(self.col) == json.dumps(other, separators=(",", ":")))

    def canonical(self) -> Column:
        return self.col

    def has(self, key: str) -> Guard:
        if isinstance(self.dtype, T.StructType):
            return self.col[key].isNotNull() if key in self.dtype.names else False
        return col_of(F.map_contains_key(self.col, F.lit(key)))

    def get(self, key: str) -> Typed | None:
        if isinstance(self.dtype, T.StructType):
            return Typed(self.col[key], self.dtype[key].dataType) if key in self.dtype.names else None
        return Typed(F.try_element_at(self.col, F.lit(key)), self.dtype.valueType)

    def keys(self) -> Column:
        if isinstance(self.dtype, T.StructType):
            return F.array_compact(F.array(*(F.when(self.col[n].isNotNull(), F.lit(n)) for n in self.dtype.names)))
        return F.map_keys(self.col)

    def each_entry(self, test) -> Guard:
        """test(key column, value) for all entries."""
        if isinstance(self.dtype, T.StructType):
            return all_of(*(implies(self.has(n), test(F.lit(n), self.get(n))) for n in self.dtype.names))
        return F.forall(F.map_entries(self.col), lambda e: column(test(e["key"], Typed(e["value"], self.dtype.valueType))))

    def items(self) -> Column:
        return self.col

    def item(self, col: Column) -> Typed:
        return Typed(col, self.dtype.elementType)


class Variant(Typed):
    """A value in a VARIANT column; SQL NULL is missing, the variant null is JSON null."""

    def __init__(self, col: Column) -> None:
        self.col = col

    def _kind(self) -> Column:
        return F.schema_of_variant(self.col)

    def is_type(self, name: str) -> Guard:
        k = self._kind()
        starts = {"string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}[name]
        fits = col_of(k.rlike("^(" + "|".join(starts) + ")"))
        if name != "integer":
            return fits
        whole = F.coalesce(self.exact() % 1 == 0, self.number() % 1 == 0)
        return F.when(k == "BIGINT", True).otherwise(fits & col_of(whole))

    def text(self) -> Column:
        return F.try_variant_get(self.col, "$", "string")

    def number(self) -> Column:
        return F.try_variant_get(self.col, "$", "double")

    def exact(self) -> Column:
        return F.try_variant_get(self.col, "$", EXACT)

    def compared(self, test, n: int | float) -> Column:
        near, exact = col_of(test(self.number(), F.lit(float(n)))), exact_literal(n)
        return near if exact is None else F.coalesce(test(self.exact(), exact), near)

    def multiple(self, step: int | float) -> Column:
        exact = exact_literal(step)
        if float(step).is_integer() and exact is not None:
            return col_of(F.coalesce(self.exact() % exact == 0, self.number() % int(step) == 0))
        return col_of(nearly_whole(self.number() / float(step)))

    def canonical(self) -> Column:
        """Text that is equal for equal JSON values."""
        kind, whole = self._kind(), F.coalesce(self.exact().cast("decimal(20,0)").cast("string"), self.number().cast("decimal(38,0)").cast("string"))
        text = F.to_json(self.col)
        nested = F.when(F.contains(kind, F.lit("DOUBLE")), F.regexp_replace(text, r"(?<=\d)\.0(?=[,}\]])", "")).otherwise(text)
        return F.when(kind == "BIGINT", text).when(col_of(self.is_type("integer")), whole).otherwise(nested)

    def equals(self, other) -> Guard:
        if isinstance(other, bool):
            return all_of(self.is_type("boolean"), col_of(F.try_variant_get(self.col, "$", "boolean") == other))
        if isinstance(other, (int, float)):
            return all_of(self.is_type("number"), self.compared(lambda x, n: x == n, other))
        if isinstance(other, str):
            return all_of(self.is_type("string"), col_of(self.text() == other))
        if other is None:
            return self.is_type("null")
        return col_of(self.canonical() == F.to_json(F.parse_json(F.lit(json.dumps(plain_json(other))))))

    def _map(self) -> Column:
        return F.try_variant_get(self.col, "$", "map<string,variant>")

    def has(self, key: str) -> Guard:
        return self.get(key).col.isNotNull()

    def get(self, key: str) -> Variant:
        if "'" in key or "\\" in key:  # names that a path can't hold
            return Variant(F.try_element_at(self._map(), F.lit(key)))
        return Variant(F.try_variant_get(self.col, f"$['{key}']", "variant"))

    def keys(self) -> Column:
        return F.map_keys(self._map())

    def each_entry(self, test) -> Guard:
        return F.forall(F.map_entries(self._map()), lambda e: column(test(e["key"], Variant(e["value"]))))

    def items(self) -> Column:
        return F.try_variant_get(self.col, "$", "array<variant>")

    def item(self, col: Column) -> Variant:
        return Variant(col)


def once(df, to: str, value: Column):
    """df with a column evaluated once a row: as it is generated, filters on it are not pushed below it, where each of
    their references would evaluate it again."""
    return df.select("*", F.explode(F.array(value)).alias(to))


def value_of(df, column: str) -> Typed:
    kind = df.schema[column].dataType
    return Variant(F.col(column)) if isinstance(kind, T.VariantType) else Typed(F.col(column), kind)
