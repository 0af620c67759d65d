"""Text helpers: class names and paths, lists of lines, key lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_of_path(path: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"^(\./)?target/test-classes/", ""), r"\.class$", ""), "/", ".")


def path_of_class(name: Column) -> Column:
    return F.concat(F.lit("./target/test-classes/"), F.translate(name, ".", "/"), F.lit(".class"))


def source_file(package: Column, cls: Column) -> Column:
    """The file of a class: its package as folders, and the outermost class."""
    return F.concat(F.translate(package, ".", "/"), F.lit("/"), F.substring_index(cls, ".", 1), F.lit(".java"))


def line_list(lines: Column) -> Column:
    """Ascending line numbers as text; an aggregate."""
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(lines)), lambda x: x.cast("string")))


def property_of(properties: Column, name: str) -> Column:
    """The value of a name in an array of (name, value); of repeated names, the last."""
    values = F.transform(F.filter(properties, lambda p: p["_name"] == name), lambda p: p["_value"])
    return F.when(F.size(values) > 0, F.element_at(values, -1))
