"""Guarded JSON extraction.

Semantics reproduced (warehouse ``JSON_EXTRACT_SCALAR`` / ``JSON_EXTRACT_ARRAY``):

* a scalar extract returns the text of a string, number or boolean;
* an object or an array at the path, a JSON ``null``, a missing path, malformed
  text (anything after the value included) or SQL NULL all give NULL;
* of repeated keys the first that is not null counts, at every level;
* an array extract keeps each element as its own JSON text, whatever its type, so
  an odd element does not void the others.

Spark's JSON functions return containers as text and strings without their
quotes, so the two look alike where a string's content starts like a container.
Such strings are rare; ``_marked`` puts a character in front of their content
before any parsing, and what then starts like a container is one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.config import PAYLOAD_KEY, PAYLOAD_KEY_PATH, PAYLOAD_VALUE_PATH

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Put in front of string contents that start like a container.
_MARK = "\x01"
#: Stands after a text under test; a text that closes too early loses it.
_END = "\x1f"

_BLANK = r"(?:\s|\\[tnr]|\\u00(?:20|09|0[aAdD]))*"
_CONTAINER_LIKE = rf'"(?={_BLANK}(?:[{{\[]|\\u00[75][bB]))'
_TOKEN = r'(?:[^"\\]++|\\.)*+'
_OTHER_TEXT = rf'((?:[^"]++|(?!{_CONTAINER_LIKE})"{_TOKEN}")*+)'


def _marked(text: Column) -> Column:
    """The JSON text with every string that starts like a container marked."""
    marked = F.regexp_replace(text, rf"\G{_OTHER_TEXT}{_CONTAINER_LIKE}({_TOKEN})\"", r'$1"\\u0001$2"')
    return F.when(text.rlike(_CONTAINER_LIKE), marked).otherwise(text)


def _scalar_at(marked: Column, path: str) -> Column:
    """Scalar text at ``path`` of a well-formed, marked text; else NULL."""
    # bound in an array: the rule looks at the text several times, which is taken out once
    return F.get(F.transform(F.array(F.get_json_object(marked, path)), _scalar), F.lit(0))


def _scalar(text: Column) -> Column:
    """A text taken out of a marked one: NULL for a container, else without the mark."""
    return (F.when(F.substring(text, 1, 1).isin("{", "["), F.lit(None))
            .when(text.startswith(_MARK), F.regexp_replace(text, rf"\A{_MARK}(?=\s*[{{\[])", "")).otherwise(text))


def _well_formed(json_text: Column) -> Column:
    """Whether the whole text is one JSON value: inside brackets, before an end
    mark, it must parse as an array of the two."""
    parsed = F.from_json(F.concat(F.lit("["), json_text, F.lit(r',"\u001f"]')), "array<string>", _STRICT)
    return F.coalesce(F.forall(F.array(parsed), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(1)) == _END)), F.lit(False))


def _may_have(col: Column, field: str) -> Column:
    """Whether the text may be an object with the field: it stands in braces and
    has the field's name, or an escape that may spell it. Others need no parser,
    which is slowest where it fails."""
    bare = F.btrim(col, F.lit(" \t\r\n"))
    return bare.startswith("{") & bare.endswith("}") & (bare.contains(f'"{field}"') | bare.contains("\\"))


def json_scalar(json_text: Column | str, field: str) -> Column:
    """``JSON_EXTRACT_SCALAR(json_text, '$.<field>')`` over a STRING column.

    A text of the one usual shape, an object with just this field and a plain
    string, is cut at its known head and tail, or taken apart by one regular
    expression where it holds blanks; all others (CASE branches are lazy) by the
    JSON parser.
    """
    col = F.col(json_text) if isinstance(json_text, str) else json_text
    head, tail = f'{{"{field}":"', '"}'
    inner = F.substring(col, F.lit(len(head) + 1), F.length(col) - len(head) - len(tail))
    compact = (col.startswith(head) & col.endswith(tail) & (F.length(col) >= len(head) + len(tail))
               & ~inner.rlike(r'["\\\x00-\x1f]'))
    blank = r"[ \t\r\n]*"
    usual = rf'\A{blank}\{{{blank}"{re.escape(field)}"{blank}:{blank}"([^"\\\x00-\x1f]*)"{blank}\}}{blank}\z'
    return F.when(compact, inner).when(col.rlike(usual), F.regexp_extract(col, usual, 1)).when(
        _may_have(col, field) & _well_formed(col), _scalar_at(_marked(col), f"$.{field}"))


def with_json_field(df, json_col: str, field: str, out_col: str):
    """Add ``out_col`` = ``json_scalar(json_col, field)``, parsed once per row.

    The value passes through a generator: filters on it (an ``IS NOT NULL``
    that a join implies, a year prefix) stay above, while a projected
    expression would be copied into every pushed-down filter and evaluated
    again there.
    """
    return df.select("*", F.explode(F.array(json_scalar(json_col, field))).alias(out_col))


def json_array(json_text: Column | str, field: str = PAYLOAD_KEY) -> Column:
    """``JSON_EXTRACT_ARRAY(json_text, '$.<field>')`` as ``array<string>``: the
    JSON text of each element (a string element's content; NULL for ``null``).

    NULL when the field is missing, is not an array, or the text is malformed.
    One parse does it all: the text stands before an end mark in an array of two
    objects, and only the field's elements are taken out of it. A text that
    names the field twice is cut down to its first one before.
    """
    col = F.col(json_text) if isinstance(json_text, str) else json_text
    name = re.escape(field)
    first = F.concat(F.lit(f'{{"{field}":'), F.coalesce(F.get_json_object(_marked(col), f"$.{field}"), F.lit("null")), F.lit("}"))
    # get_json_object gives a string's content, which is no JSON value here unless it looks like one
    no_string = F.coalesce(F.get_json_object(_marked(col), f"$.{field}").rlike(r"\A\["), F.lit(False))
    text = F.when(col.rlike(rf'(?s)"{name}".*"{name}"|\\u'),
                  F.when(_well_formed(col) & no_string & col.rlike(r"\A\s*\{"), first)).otherwise(_marked(col))
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{field}":["\\u001f"]}}]')), f"array<struct<{field}:array<string>>>", _STRICT)
    whole = F.filter(F.array(parsed), lambda p: (F.size(p) == 2) & (F.get(F.get(p, F.lit(1))[field], F.lit(0)) == _END))
    return F.when(_may_have(col, field), F.get(F.get(whole, F.lit(0)), F.lit(0))[field])


def element_key(e: Column) -> Column:
    """``$.key`` of one array element. Not type-guarded: the JSON text of an
    object or array can never equal a key name, so comparisons are unaffected."""
    return F.get_json_object(e, PAYLOAD_KEY_PATH)


def element_value(e: Column) -> Column:
    """``$.value`` of one array element by the scalar rule."""
    return _scalar_at(e, PAYLOAD_VALUE_PATH)


def _pair(key: str) -> str:
    """Regular expression of a plain element: an object with a key and a value,
    both strings without escapes. ``key`` is an expression for the key's content."""
    blank = r"[ \t\r\n]*+"
    return (rf'\{{{blank}"key"{blank}:{blank}"{key}"{blank},{blank}"value"{blank}:{blank}"([^"\\\x00-\x1f]*+)"{blank}\}}{blank}')


def plain_pairs(json_text: Column, field: str = PAYLOAD_KEY) -> Column:
    """Whether the text is an object with just this field, an array of plain
    elements: of such a text, which holds no quote but its own, ``plain_value``
    and ``plain_count`` read what ``json_array`` and the scalar rule would give."""
    blank, pair = r"[ \t\r\n]*+", _pair(r'[^"\\\x00-\x1f]*+')
    return F.coalesce(json_text.rlike(rf'\A{blank}\{{{blank}"{re.escape(field)}"{blank}:{blank}\[{blank}(?:{pair}(?:,{blank}{pair})*+)?+\]{blank}\}}{blank}\z'),
                      F.lit(False))


def plain_value(json_text: Column, key: str) -> Column:
    """``max_value_for_key`` of a text of ``plain_pairs``."""
    return F.array_max(F.regexp_extract_all(json_text, F.lit(_pair(re.escape(key))), F.lit(1)))


def plain_count(json_text: Column) -> Column:
    """Number of elements of a text of ``plain_pairs``: two quotes stand around
    the field's name, eight in each element."""
    quotes = F.octet_length(json_text) - F.octet_length(F.replace(json_text, F.lit('"'), F.lit("")))
    return F.shiftright(quotes - 2, 3)


def max_value_for_key(arr: Column, key: str) -> Column:
    """Per row: ``MAX(IF($.key = key, $.value, NULL))`` over the array's elements.

    Higher-order functions keep this one expression per row (no explode); the
    result is NULL when no element carries the key or the array is NULL/empty.
    An element whose text has neither the key nor an escape is not parsed.
    """
    named = F.filter(arr, lambda e: (e.contains(key) | e.contains("\\")) & (element_key(e) == F.lit(key)))
    # the text is bound before the rule looks at it, so that it is taken out once
    return F.array_max(F.transform(F.transform(named, lambda e: F.get_json_object(e, PAYLOAD_VALUE_PATH)), _scalar))
