"""YAML frontmatter text to maps of kinds, texts and lists by path.

The one step that built-in expressions cannot express: nested block YAML.  It
runs as an Arrow batch function on the (short) frontmatter block only; all
rules about the values are column expressions over the resulting maps.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The C parser reads the same language several times faster.
LOADER = getattr(yaml, "CBaseLoader", yaml.BaseLoader)

_INT = re.compile(r"[-+]?[0-9]+$")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?$")


def _plain(text: str):
    """A plain scalar under the core schema: null, bool, number, else string."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if _INT.match(text):
        return int(text)
    if _FLOAT.match(text):
        number = float(text)
        return int(number) if number.is_integer() else number
    return text


def _value(node):
    if isinstance(node, yaml.ScalarNode):
        return node.value if node.style else _plain(node.value)
    if isinstance(node, yaml.SequenceNode):
        return [_value(n) for n in node.value]
    out = {}
    for key, value in node.value:
        name = str(key.value)
        if name in out:
            raise yaml.YAMLError(f"Map keys must be unique: {name}")
        out[name] = _value(value)
    return out


KINDS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", dict: "map"}


def _kind(value) -> str:
    if isinstance(value, list):
        return "list:string" if all(isinstance(v, str) for v in value) else "list"
    return KINDS[type(value)]


def _text(value) -> str:
    """Text of a scalar; empty for anything else."""
    if type(value) is str:
        return value
    kind = _kind(value)
    if kind == "boolean":
        return "true" if value else "false"
    return str(value) if kind == "number" else ""


# Plain words, one-line quoted texts and one-line lists mean the same wherever they
# stand; a block of such entries, nested once at most, needs no general parser.
_WORD = r"[A-Za-z0-9_](?:[A-Za-z0-9_./-]| (?=[A-Za-z0-9_]))*+"
_ENTRY = re.compile(
    rf"(  )?([A-Za-z_][A-Za-z0-9_]{{0,99}}):(?: (?:({_WORD})|'([ -&(-~]*)'|\[((?:{_WORD}(?:, {_WORD})*+)?)\]))?(?:\n|\Z)")


def _simple(text: str) -> dict | None:
    """Entries of a simple block; None for any other, which the YAML parser reads."""
    out: dict = {}
    inner, parent, at, end = None, None, 0, len(text)
    while at < end:
        m = _ENTRY.match(text, at)
        if m is None:
            return None
        at = m.end()
        nested, name, word, quoted, items = m.groups()
        if word is not None:
            value = _plain(word)
        elif quoted is not None:
            value = quoted
        elif items is not None:
            value = [_plain(x) for x in items.split(", ")] if items else []
        else:
            value = None
        if nested:
            if parent is None:
                return None
            if inner is None:
                inner = out[parent] = {}
            if name in inner:
                return None
            inner[name] = value
        else:
            if name in out:
                return None
            out[name] = value
            # Only a key without a value of its own may hold others.
            inner, parent = None, name if word is None and quoted is None and items is None else None
    return out or None


def _read(text: str | None) -> dict:
    out = dict.fromkeys(COLUMNS)
    if text is None:
        return out
    try:
        value = _simple(text)
        if value is None:
            node = yaml.compose(text, Loader=LOADER)
            value = None if node is None else _value(node)
    except Exception as err:  # any malformed block becomes an error row
        out["error"] = str(err).split("\n")[0]
        return out
    if not isinstance(value, dict):
        out["error"] = "Frontmatter root must be a YAML mapping object."
        return out
    # Values by path, one nested level deep: "tags", "links.parents".
    flat = dict(value)
    for key, inner in value.items():
        if isinstance(inner, dict):
            flat.update({f"{key}.{k}": v for k, v in inner.items()})
    out["json"] = json.dumps(value)
    out["keys"] = list(value)
    out["kinds"] = {k: _kind(v) for k, v in flat.items()}
    out["texts"] = {k: _text(flat[k]) for k, kind in out["kinds"].items() if kind in ("string", "boolean", "number")}
    out["lists"] = {k: [_text(x) for x in v] for k, v in flat.items() if isinstance(v, list)}
    return out


TEXT = T.StringType()
COLUMNS = {
    "json": TEXT,
    "error": TEXT,
    "keys": T.ArrayType(TEXT),
    "kinds": T.MapType(TEXT, TEXT),
    "texts": T.MapType(TEXT, TEXT),
    "lists": T.MapType(TEXT, T.ArrayType(TEXT)),
}


def _offsets(values: list) -> pa.Array:
    """Starts of the values' items in their concatenation; NULL where there is no value."""
    ends = accumulate((len(v) if v is not None else 0 for v in values), initial=0)
    return pa.array([None if v is None else at for at, v in zip(ends, [*values, ()])], pa.int32())


def _column(values: list, kind: T.DataType) -> pa.Array:
    held = [v for v in values if v is not None]
    if kind == TEXT:
        return pa.array(values, pa.string())
    if isinstance(kind, T.ArrayType):
        return pa.ListArray.from_arrays(_offsets(values), pa.array([x for v in held for x in v], pa.string()))
    return pa.MapArray.from_arrays(
        _offsets(values), pa.array([k for v in held for k in v], pa.string()), _column([x for v in held for x in v.values()], kind.valueType))


@F.arrow_udf(T.StructType([T.StructField(k, t) for k, t in COLUMNS.items()]))
def read_blocks(blocks: pa.Array) -> pa.Array:
    """Typed contents of each block, or the reason why there are none."""
    rows = [_read(b) for b in blocks.to_pylist()]
    return pa.StructArray.from_arrays([_column([r[k] for r in rows], t) for k, t in COLUMNS.items()], list(COLUMNS))
