"""What changed between two snapshots of a table, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that differ by no more than this share of the larger one are equal.
TOLERANCE = 1e-9


def _shown(c: Column, kind: T.DataType) -> Column:
    """A value as text; nested ones as JSON."""
    return F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else c.cast("string")


def _differs(old: Column, new: Column, a: T.DataType, b: T.DataType) -> Column:
    """Null-safe, by kind: numbers of any two types by value, others of one type as they are, of two types by their text."""
    both = old.isNotNull() & new.isNotNull()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.FractionalType) or isinstance(b, T.FractionalType):
            x, y = old.cast("double"), new.cast("double")
            far = ~x.eqNullSafe(y) & ~(F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y)))
        else:
            far = old != new
    elif isinstance(a, T.NumericType) != isinstance(b, T.NumericType) and T.StringType() in (a, b):
        # A number and a text are equal where the text reads as the number.
        far = ~F.coalesce(old.try_cast("double") == new.try_cast("double"), F.lit(False))
    else:
        far = _shown(old, a) != _shown(new, b)
    return F.when(both, F.coalesce(far, F.lit(True))).otherwise(old.isNotNull() | new.isNotNull())


def field_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, change, old, new) of all that differs between two tables of one row a key; old and new are text.

    change: `value` in a field of both; `field_added` and `field_lost` for values of a field that one side lacks; `row_added` and
    `row_lost` once a row that one side lacks, without a field. Null keys meet null keys. Fields may have changed their type.
    One full join, and no row for a field that stayed.
    """
    before, after = {f.name: f.dataType for f in old.schema.fields}, {f.name: f.dataType for f in new.schema.fields}
    fields = [c for c in dict.fromkeys([*before, *after]) if c not in keys]
    a = old.select(*(F.col(f"`{k}`").alias(f"\1k{i}") for i, k in enumerate(keys)), F.struct(F.lit(True).alias("\1there"), *(F.col(f"`{c}`") for c in before if c not in keys)).alias("\1old"))
    b = new.select(*(F.col(f"`{k}`").alias(f"\1l{i}") for i, k in enumerate(keys)), F.struct(F.lit(True).alias("\1there"), *(F.col(f"`{c}`") for c in after if c not in keys)).alias("\1new"))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"\1k{i}").eqNullSafe(F.col(f"\1l{i}"))
    met = a.join(b, same, "full")
    x, y = F.col("\1old"), F.col("\1new")
    none = F.lit(None).cast("string")
    change = lambda field, kind, p, q: F.struct(F.lit(field).cast("string").alias("field"), F.lit(kind).alias("change"), p.alias("old"), q.alias("new"))
    both = x.isNotNull() & y.isNotNull()
    found = [F.when(x.isNull(), change(None, "row_added", none, none)), F.when(y.isNull(), change(None, "row_lost", none, none))]
    for c in fields:
        if c not in before:
            found.append(F.when(both & y[c].isNotNull(), change(c, "field_added", none, _shown(y[c], after[c]))))
        elif c not in after:
            found.append(F.when(both & x[c].isNotNull(), change(c, "field_lost", _shown(x[c], before[c]), none)))
        else:
            found.append(F.when(both & _differs(x[c], y[c], before[c], after[c]), change(c, "value", _shown(x[c], before[c]), _shown(y[c], after[c]))))
    own = [F.coalesce(f"\1k{i}", f"\1l{i}").alias(k) for i, k in enumerate(keys)]
    return met.select(*own, F.explode(F.array_compact(F.array(*found))).alias("\1x")).select(*(f"`{k}`" for k in keys), "\1x.field", "\1x.change", "\1x.old", "\1x.new")


def schema_changes(old: DataFrame, new: DataFrame) -> list[tuple[str, str, str, str]]:
    """(field, change, old type, new type) of fields added, lost and retyped, in order of both schemas."""
    a, b = ({f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (old, new))
    out = []
    for c in dict.fromkeys([*a, *b]):
        if a.get(c) != b.get(c):
            out.append((c, "added" if c not in a else "lost" if c not in b else "retyped", a.get(c, ""), b.get(c, "")))
    return out
