"""Repair of text that was read in the wrong encoding, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that UTF-8 read as Latin-1 or Windows-1252 leaves, and the characters of
# Windows-1252 that Latin-1 lacks, with their bytes.
MARKS = "[ÂÃâ]"
OTHERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
PLACES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def _reread(text: Column) -> Column:
    """Text of characters of one byte, its bytes read as UTF-8; null if they aren't."""
    return F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def repaired(text: Column) -> Column:
    """Text with marks of a wrong reading, read again as UTF-8, if its characters are those of Latin-1 or
    else of Windows-1252 and their bytes are UTF-8; other text as it is. Null stays null."""
    latin = text.rlike(r"(?s)\A[\x{0}-\x{FF}]*\z")
    windows = text.rlike(rf"(?s)\A[\x{{0}}-\x{{7F}}\x{{A0}}-\x{{FF}}{OTHERS}]*\z")
    first = F.when(latin, _reread(text))
    second = F.when(windows, _reread(F.translate(text, OTHERS, PLACES)))
    return F.when(text.rlike(MARKS), F.coalesce(first, second, text)).otherwise(text)


def repaired_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type with all its texts repaired, keys of maps too; of keys that become equal the
    last one stays."""
    if isinstance(kind, T.StringType):
        return repaired(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: repaired_value(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [repaired_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(repaired_value(e["key"], kind.keyType).alias("key"), repaired_value(e["value"], kind.valueType).alias("value")))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.lit(0), F.size(entries) - i - 1)), lambda x: x["key"] == e["key"]))
        return F.map_from_entries(last)
    return value
