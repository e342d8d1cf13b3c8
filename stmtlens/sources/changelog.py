"""Changelog XML to rows.

The order of sibling operations is meaning, and the built-in XML reader groups
siblings by tag.  So one pandas function shreds each file with the standard XML
parser; Spark hands it batches of whole files and everything after it is SQL.
"""

from __future__ import annotations

import sys
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Ship the shredder itself to the executors: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOT_TAG = "databaseChangeLog"

#: Rows: one ``file`` row (name = root tag, value = parse error), then the root's
#: children in order.  ``item`` numbers root children, ``seq`` the operations in one.
OUT = (
    "item int, seq int, op string, table_name string, index_name string, name string, "
    "value string, relative boolean, "
    "columns array<struct<name:string,type:string,pk:boolean,uniq:boolean>>"
)
_OPS = {
    "createTable", "addColumn", "createIndex", "addPrimaryKey", "addUniqueConstraint", "dropIndex",
}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _flag(element, name) -> bool:
    return element.get(name, "false").strip().lower() == "true"


def _columns(op) -> list:
    found = []
    for column in op:
        if _tag(column) != "column":
            continue
        inline = [c for c in column if _tag(c) == "constraints"]
        last = inline[-1] if inline else None
        found.append(
            (
                column.get("name", ""),
                column.get("type", ""),
                last is not None and _flag(last, "primaryKey"),
                last is not None and _flag(last, "unique"),
            )
        )
    return found


def _shred(content: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(content)
    except ET.ParseError as error:
        yield (-1, 0, "file", None, None, None, str(error), False, [])
        return
    yield (-1, 0, "file", None, None, _tag(root), None, False, [])
    for item, child in enumerate(root):
        tag = _tag(child)
        if tag == "property":
            yield (item, 0, tag, None, None, child.get("name"), child.get("value"), False, [])
        elif tag in ("include", "includeAll"):
            yield (item, 0, tag, None, None, None, child.get("file"),
                   _flag(child, "relativeToChangelogFile"), [])
        elif tag == "changeSet":
            yield (item, -1, tag, None, None, child.get("id"), None, False, [])
            for seq, op in enumerate(child):
                kind = _tag(op)
                if kind in _OPS:
                    names = op.get("columnNames")
                    listed = (
                        _columns(op) if names is None
                        else [(n.strip(), "", False, False) for n in names.split(",") if n.strip()]
                    )
                    yield (item, seq, kind, op.get("tableName"),
                           op.get("indexName") or op.get("constraintName"), None, names, False, listed)


def scan_changelogs(files: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Operation rows of changelog files ``(keys, content)``."""
    schema = files.select(*keys).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    names = [part.split()[0] for part in
             "item int,seq int,op string,table_name string,index_name string,name string,"
             "value string,relative boolean,columns array".split(",")]

    def shred(batches):
        for batch in batches:
            rows = [
                (*key, *row)
                for *key, content in zip(*[batch[k] for k in keys], batch["content"])
                for row in _shred(content)
            ]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return files.select(*keys, "content").mapInPandas(shred, f"{fields}, {OUT}")
