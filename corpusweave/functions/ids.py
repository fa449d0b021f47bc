"""X5 / X6 as Column expressions (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_of(path: Column) -> Column:
    """Repo-relative path -> dotted module: '/' and '\\' -> '.', strip '.py'."""
    return F.regexp_replace(F.translate(path, "/\\", ".."), r"\.py$", "")


def symbol_id(path: Column, chunk_type: Column, class_name: Column, name: Column) -> Column:
    """module[.Class].name; a class chunk's own id is module.Class."""
    cls = F.when(chunk_type == F.lit("function_definition"), class_name)
    return F.concat_ws(".", module_of(path), cls, name)


def qualified_name(chunk_type: Column, class_name: Column, name: Column) -> Column:
    cls = F.when(chunk_type == F.lit("function_definition"), class_name)
    return F.concat_ws(".", cls, name)


def chunk_id(path: Column, chunk_type: Column, class_name: Column, name: Column) -> Column:
    """md5(path + '::' + name), name = Class.method for methods."""
    return F.md5(F.concat(path, F.lit("::"), qualified_name(chunk_type, class_name, name)))
