"""One spelling for the names that the curation tables write in many ways.

Every function takes and gives a Column, null in gives null out, and a value that names nothing gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is no clip although it stands among clip names; splits; archive and export endings.
ARCHIVE_END = r"(\.v\d+i\.[a-z0-9]+|\.(zip|tar|tgz|gz|rar|7z))+$"
PATH_SCHEME = r"^file:(//)?"
RAW_ROOT = r"^(?i)(/?datasets/)?_?raw/"
EXPORT_MARK = r"_[A-Za-z]+\.rf\.[0-9a-fA-F]+$"
EXTENSION = r"\.[A-Za-z0-9]{1,5}$"
CLIP_STAMP = r"(\d{4})-(\d{2})-(\d{2})[^0-9]+(\d{2})[^0-9](\d{2})[^0-9](\d{2})"

_WIDE = "".join(map(chr, (0xA0, 0x2007, 0x202F, 0x200B, 0xFEFF)))
_BLANKS = "\t\n\x0b\f\r" + _WIDE


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def split_key(c: Column) -> Column:
    """train, val or test; ``valid`` and ``validation`` are val, anything else is no split."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("valid", "validation"), F.lit("val")).when(s.isin("train", "val", "test"), s)


def source_key(c: Column) -> Column:
    """Slug and batch code of a source without folder, archive ending, case and separators."""
    s = F.translate(c, _BLANKS + "\\", " " * len(_BLANKS) + "/")
    s = F.trim(F.lower(F.substring_index(F.rtrim(s, F.lit("/ ")), "/", -1)))
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, ARCHIVE_END, "")).otherwise(s)
    return _blank_to_null(F.regexp_replace(s, "[^a-z0-9]", ""))


def path_key(c: Column) -> Column:
    """Path below the raw root, with one kind of slash and without scheme and dots."""
    s = F.translate(F.btrim(c, F.lit(" " + _BLANKS)), "\\", "/")
    s = F.regexp_replace(s, PATH_SCHEME, "")
    s = F.when(F.contains(s, F.lit("//")), F.regexp_replace(s, "/{2,}", "/")).otherwise(s)
    s = F.regexp_replace(s, r"^(\./)+", "")
    return _blank_to_null(F.regexp_replace(s, RAW_ROOT, ""))


def file_stem(c: Column) -> Column:
    """File name without folder, extension and the exporter's mark for a copy."""
    s = F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)$", 1)
    return _blank_to_null(F.regexp_replace(F.regexp_replace(F.trim(s), EXTENSION, ""), EXPORT_MARK, ""))


def clip_key(c: Column) -> Column:
    """Date and time in a clip's name as 14 digits."""
    parts = [F.regexp_extract(c, CLIP_STAMP, i) for i in range(1, 7)]
    return _blank_to_null(F.concat(*parts))


def clip_keys(c: Column) -> Column:
    """Distinct clips of an array; an empty array where it is null or names none."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, clip_key), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def label_set(c: Column) -> Column:
    """Labels of a comma or semicolon list, lower case, distinct and sorted, as one string; none gives ''."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), ",")
