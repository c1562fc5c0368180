"""Deeply nested JSON documents as flat, related tables.

A document is parsed once to a VARIANT, which is stored. A single higher-order expression then walks it level by level: nested
``transform`` calls attach the ancestor's path and the place or field name to every child, ``flatten`` joins the
children of a level, and one ``inline`` per target table emits the rows. A node is cast to its map or array once and
carries that to the next level. The number of levels is taken from each document's own bracket depth, so no depth is
cut off. Documents beyond the limits of Spark's JSON parser (depth, lengths of numbers, names and strings) are read and
walked in Python without recursion, for all tables alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import written

# A value as a container: its map or its array. Scalars, which have neither, are left out before any path is made.
_CONTAINER = "'obj', try_variant_get({v}, '$', 'map<string,variant>'), 'arr', try_variant_get({v}, '$', 'array<variant>')"
_IS_CONTAINER = "{x}.obj IS NOT NULL OR {x}.arr IS NOT NULL"

# The containers among the children of a frontier: the entries of its objects and the places of its arrays.
_CHILDREN = f"""
flatten(transform(s.frontier, n -> concat(
  transform(
    filter(
      transform(coalesce(map_entries(n.obj), array()), e -> named_struct('key', e.key, {_CONTAINER.format(v="e.value")})),
      z -> {_IS_CONTAINER.format(x="z")}),
    z -> named_struct(
      'path', concat(n.path, '/', replace(replace(z.key, '~', '~0'), '/', '~1')),
      'parent', n.path, 'field', z.key, 'place', '', 'obj', z.obj, 'arr', z.arr)),
  transform(
    filter(
      transform(coalesce(n.arr, array()), (x, i) -> named_struct('key', cast(i AS string), {_CONTAINER.format(v="x")})),
      z -> {_IS_CONTAINER.format(x="z")}),
    z -> named_struct(
      'path', concat(n.path, '/', z.key), 'parent', n.parent, 'field', n.field,
      'place', if(n.place = '', z.key, concat(n.place, '/', z.key)), 'obj', z.obj, 'arr', z.arr)))))
"""

NODES = "array<struct<path:string,parent:string,field:string,place:string,obj:map<string,variant>,arr:array<variant>>>"
PATHS = "array<struct<path:string,parent:string>>"

# Depth of brackets outside of strings: one pass over the few characters that remain.
_DEPTH = r"""
aggregate(
  split(regexp_replace(regexp_replace(value, '"(?:[^"\\\\]|\\\\.)*+"', ''), '[^\\[\\]{}]', ''), ''),
  named_struct('d', 0, 'm', 0),
  (s, c) -> named_struct(
    'd', s.d + case when c in ('{', '[') then 1 when c in ('}', ']') then -1 else 0 end,
    'm', greatest(s.m, s.d + case when c in ('{', '[') then 1 else 0 end)),
  s -> s.m)
"""


def _walk(kept: str, kind: str) -> str:
    """The walk as one expression; ``kept`` says what of a level's frontier ``s.frontier`` is collected."""
    root = f"array(named_struct('path', '#', 'parent', '', 'field', '', 'place', '', {_CONTAINER.format(v='doc')}))"
    return f"""
aggregate(
  sequence(1, depth),
  named_struct('frontier', cast(filter({root}, c -> {_IS_CONTAINER.format(x="c")}) AS {NODES}), 'found', cast(array() AS {kind})),
  (s, level) -> named_struct('frontier', cast({_CHILDREN} AS {NODES}), 'found', concat(s.found, {kept})),
  s -> s.found)"""


_OBJECT_PATHS = "transform(filter(s.frontier, c -> c.obj IS NOT NULL), c -> named_struct('path', c.path, 'parent', c.parent))"


def parsed_documents(jsonld: DataFrame) -> DataFrame:
    """``content_id, node_index, doc, depth, odd`` of the distinct documents whose ``parse_error`` is null.

    Whole-row repetition is taken away by a combining aggregate before anything is parsed. Each document is parsed once:
    the VARIANTs are written to the shared folder, from where the walk and the reader of odd documents take them. A null
    value is left out; one that is no JSON for Spark's parser has a null ``doc`` and stands in ``odd``. Where a key is
    repeated within an object its last value holds.
    """
    spark = jsonld.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = jsonld.where("parse_error IS NULL AND value IS NOT NULL").select("content_id", "node_index", "value")
    doc = F.expr("try_parse_json(value)")
    depth = F.greatest(F.lit(1), F.expr(_DEPTH)).alias("depth")
    return written(rows.distinct().select("content_id", "node_index", doc.alias("doc"), depth, F.when(doc.isNull(), F.col("value")).alias("odd")), "documents")


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


class Number(str):
    """A number as it is written."""


def read_json(text: str, strict: bool = False) -> Any:
    """The value of a JSON text, read with a stack of its own, so that no depth is too much. Numbers keep their text.

    Raises ``ValueError`` where the text is no JSON; ``NaN`` and infinities are numbers unless ``strict``.
    """
    at, stack, out = _SPACE.match(text, 0).end(), [], []
    # A stack entry is the container and the key at which its next value goes; ``out`` is the outermost one.
    holder: Any = out
    key: str | None = None

    def take_key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("a name is missing")
        name, at = scanstring(text, at + 1, True)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("a colon is missing")
        return name, _SPACE.match(text, at + 1).end()

    while True:
        c, opened = text[at : at + 1], None
        if c == "{" or c == "[":
            value: Any = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                opened = value
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _SCALAR.match(text, at)
            if not m or strict and m.group()[-1] in "Ny":
                raise ValueError("a value is missing")
            word, at = m.group(), m.end()
            value = {"true": True, "false": False, "null": None}.get(word, Number(word))
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        if opened is not None:
            stack.append(holder)
            holder = opened
            if isinstance(opened, dict):
                key, at = take_key(at)
            continue
        at = _SPACE.match(text, at).end()
        while stack and text[at : at + 1] == ("}" if isinstance(holder, dict) else "]"):
            holder, at = stack.pop(), _SPACE.match(text, at + 1).end()
        if not stack:
            if at != len(text):
                raise ValueError("text after the value")
            return out[0]
        if text[at : at + 1] != ",":
            raise ValueError("a comma is missing")
        at = _SPACE.match(text, at + 1).end()
        if isinstance(holder, dict):
            key, at = take_key(at)


def _scalar(x: Any) -> tuple[str, str | None]:
    if x is None:
        return "null", None
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    return ("number" if isinstance(x, Number) else "string"), str(x)


def _rows(doc: Any) -> Iterator[tuple[str, str, str | None, str | None, int | None, str | None, str | None, str | None]]:
    """``part, obj_path, parent_path, field, type_no, place, kind, text`` of one document for all tables, by a stack."""
    stack = [("#", "", "", "", doc)]
    while stack:
        path, parent, field, place, x = stack.pop()
        if isinstance(x, dict):
            yield "object", path, parent, None, None, None, None, None
            types = x.get("@type")
            for i, t in enumerate(types if isinstance(types, list) else [types]):
                if _scalar(t)[0] == "string" and not isinstance(t, (dict, list)):
                    yield "type", path, None, None, i, None, None, t
            for k, y in x.items():
                if isinstance(y, (dict, list)):
                    stack.append((f"{path}/{k.replace('~', '~0').replace('/', '~1')}", path, k, "", y))
                else:
                    yield "field", path, None, k, None, None, *_scalar(y)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                at = f"{place}/{i}" if place else str(i)
                if isinstance(y, (dict, list)):
                    stack.append((f"{path}/{i}", parent, field, at, y))
                else:
                    yield "element", parent, None, field, None, at, *_scalar(y)


_COLUMNS = {"object": "obj_path, parent_path", "type": "obj_path, type_no, text AS obj_type", "field": "obj_path, field, kind, text", "element": "obj_path, field, place, kind, text"}


def _odd(docs: DataFrame, part: str) -> DataFrame:
    """The rows of one table from the documents that Spark's parser does not take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, node, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    rows = [r[1:] for r in _rows(read_json(value)) if r[0] == part]
                except ValueError:
                    continue
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                arrays = [pa.array([cid] * len(rows), pa.string()), pa.array([node] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["content_id", "node_index", "obj_path", "parent_path", "field", "type_no", "place", "kind", "text"])

    schema = "content_id string, node_index int, obj_path string, parent_path string, field string, type_no int, place string, kind string, text string"
    odd = docs.where("odd IS NOT NULL").selectExpr("cast(content_id AS string) AS content_id", "cast(node_index AS int) AS node_index", "odd")
    return odd.mapInArrow(run, schema).selectExpr("content_id", "node_index", *_COLUMNS[part].split(", "))


def walked(docs: DataFrame, kept: str = "s.frontier", kind: str = NODES) -> DataFrame:
    """``content_id, node_index, found``: every document with the array of its objects and arrays, each with the path of
    the nearest object around it, the field it stands in and its place there."""
    return docs.where("odd IS NULL").select("content_id", "node_index", F.expr(_walk(kept, kind)).alias("found"))


def _once(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of a table, each once. Paths are unique within a document, so rows repeat only where one script element
    has documents of different wording; without any, a second shuffle would find nothing."""
    twice = docs.groupBy("content_id", "node_index").count().where("count > 1")
    return rows if twice.isEmpty() else rows.distinct()


def _table(jsonld: DataFrame, part: str, rows: str) -> DataFrame:
    docs = parsed_documents(jsonld)
    flat = walked(docs).select("content_id", "node_index", F.expr(f"inline({rows})"))
    return _once(flat.unionByName(_odd(docs, part)), docs)


def objects(jsonld: DataFrame) -> DataFrame:
    """One row for each JSON object: ``content_id, node_index, obj_path, parent_path``, distinct.

    ``obj_path`` is ``#`` and the JSON Pointer, ``parent_path`` that of the nearest object around it or ''.
    Scalars and arrays at the top give no row by themselves. Null values, values that are no JSON and documents with
    a ``parse_error`` give no rows; null ids are kept as they are. Text that holds JSON stays text. Other columns are
    not read. An empty table gives an empty result.
    """
    docs = parsed_documents(jsonld)
    flat = walked(docs, _OBJECT_PATHS, PATHS).select("content_id", "node_index", F.expr("inline(found) AS (obj_path, parent_path)"))
    return _once(flat.unionByName(_odd(docs, "object")), docs)


# Whether a value is a scalar, its JSON kind and its text.
_IS_SCALAR = "try_variant_get({x}, '$', 'map<string,variant>') IS NULL AND try_variant_get({x}, '$', 'array<variant>') IS NULL"
_KIND = "case schema_of_variant({x}) when 'STRING' then 'string' when 'VOID' then 'null' when 'BOOLEAN' then 'boolean' else 'number' end"
_TEXT = "if(is_variant_null({x}), null, try_variant_get({x}, '$', 'string'))"


def object_types(jsonld: DataFrame) -> DataFrame:
    """One row for each object and ``@type`` it declares: the keys of ``objects``, ``type_no``, ``obj_type``.

    ``@type`` may be a string or an array of strings; other kinds give no row, objects without it neither.
    """
    return _table(
        jsonld,
        "type",
        """flatten(transform(filter(found, c -> c.obj IS NOT NULL), c -> transform(
             filter(
               transform(
                 coalesce(try_variant_get(try_element_at(c.obj, '@type'), '$', 'array<variant>'), array(try_element_at(c.obj, '@type'))),
                 (x, i) -> named_struct('i', i, 't', if(schema_of_variant(x) = 'STRING', try_variant_get(x, '$', 'string'), null))),
               y -> y.t IS NOT NULL),
             y -> named_struct('obj_path', c.path, 'type_no', y.i, 'obj_type', y.t))))""",
    )


def fields(jsonld: DataFrame) -> DataFrame:
    """One row for each scalar field of each object: keys of ``objects``, ``field``, ``kind``, ``text``.

    ``kind`` is string, number, boolean or null (whose ``text`` is null). Fields that hold objects or arrays are rows
    of ``objects`` and ``elements`` instead.
    """
    x = "e.value"
    return _table(
        jsonld,
        "field",
        f"""flatten(transform(filter(found, c -> c.obj IS NOT NULL), c -> transform(
              filter(map_entries(c.obj), e -> {_IS_SCALAR.format(x=x)}),
              e -> named_struct('obj_path', c.path, 'field', e.key, 'kind', {_KIND.format(x=x)}, 'text', {_TEXT.format(x=x)}))))""",
    )


def elements(jsonld: DataFrame) -> DataFrame:
    """One row for each scalar that stands in an array: ``obj_path, field, place, kind, text`` with the ids.

    ``obj_path`` is the nearest object around the array and ``field`` its field that holds the array, both '' for an
    array at the top; ``place`` are the places from there on, joined by ``/`` where arrays stand in arrays.
    """
    x = "y.x"
    return _table(
        jsonld,
        "element",
        f"""flatten(transform(filter(found, c -> c.arr IS NOT NULL), c -> transform(
              filter(transform(c.arr, (x, i) -> named_struct('i', cast(i AS string), 'x', x)), y -> {_IS_SCALAR.format(x=x)}),
              y -> named_struct('obj_path', c.parent, 'field', c.field, 'place', if(c.place = '', y.i, concat(c.place, '/', y.i)),
                'kind', {_KIND.format(x=x)}, 'text', {_TEXT.format(x=x)}))))""",
    )
