"""SQL expressions for strict JSON: one complete document per message, no type coercion.

A message is parsed inside brackets, ``[message]``, so that the parsed value is an
array of one element and ``$[0]`` addresses the document. Nothing here is a UDF. The
expressions are SQL text because a streaming query builds them anew for every window.
"""

from __future__ import annotations

from pyspark.sql import types as T

JSON_BLANKS = " \t\r\n"

# Text that may hold a number beyond the range of a double. Such text is rare, so the
# exact check behind it hardly ever runs.
MAYBE_HUGE_NUMBER = r"[0-9](?:[eE]\+?[0-9]{3}|[0-9]{208})"
STRING_LITERAL = r'"(?:[^"\\]|\\.)*+"'
NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"

# For finding \uD800-\uDFFF escapes that do not form a high-low pair.
PLAIN_ESCAPE = r"\\[^u]"
SURROGATE_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
SURROGATE = r"\\u[dD][89a-fA-F]"


def has_huge_number(text: str) -> str:
    """True if a number outside string literals does not fit a double."""
    return f"""{text} RLIKE r'{MAYBE_HUGE_NUMBER}' AND arrays_overlap(
        CAST(regexp_extract_all(regexp_replace({text}, r'{STRING_LITERAL}', '""'), r'{NUMBER}')
            AS ARRAY<DOUBLE>),
        array(DOUBLE('Infinity'), DOUBLE('-Infinity')))"""


def has_lone_surrogate(text: str) -> str:
    without_escapes = f"regexp_replace({text}, r'{PLAIN_ESCAPE}', '')"
    without_pairs = f"regexp_replace({without_escapes}, r'{SURROGATE_PAIR}', '')"
    return f"contains({text}, r'\\u') AND {without_pairs} RLIKE r'{SURROGATE}'"


def bracketed(text: str) -> str:
    """``[text]`` as VARIANT, or null if text is certainly not one strict document.

    The parser ignores whatever follows the first complete document, so text could
    close the bracket early. Without ``]`` it cannot; with one, it must also parse
    inside an object, and no text can close both wrappers early. What remains, more
    than one element, is left to :func:`is_single`.
    """
    return f"""CASE WHEN trim(BOTH '{JSON_BLANKS}' FROM {text}) <> ''
        AND (NOT contains({text}, ']')
            OR try_parse_json(concat('{{"v":', {text}, '}}')) IS NOT NULL)
        AND NOT ({has_lone_surrogate(text)})
        AND NOT ({has_huge_number(text)})
        THEN try_parse_json(concat('[', {text}, ']')) END"""


def is_single(doc: str) -> str:
    return f"({doc} IS NOT NULL AND try_variant_get({doc}, '$[1]', 'variant') IS NULL)"


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _get(doc: str, name: str, target: str) -> str:
    path = f"$[0]['{name}']" if '"' in name else f'$[0]["{name}"]'
    return f"try_variant_get({doc}, {sql_string(path)}, '{target}')"


def is_missing(doc: str, name: str) -> str:
    """No such field: an absent name, or a document that is not an object."""
    return f"{_get(doc, name, 'variant')} IS NULL"


def typed_field(doc: str, name: str, dtype: T.DataType, int32_overflow: str = "null") -> str:
    """The field as ``dtype`` if its JSON type is exactly that, else null."""
    if isinstance(dtype, T.StringType):
        # Of all JSON types only a string converts to binary.
        return f"CAST({_get(doc, name, 'binary')} AS STRING)"
    found = f"schema_of_variant({_get(doc, name, 'variant')})"
    if isinstance(dtype, T.LongType):
        return f"IF({found} = 'BIGINT', {_get(doc, name, 'bigint')}, NULL)"
    if isinstance(dtype, T.IntegerType):
        return as_int32(typed_field(doc, name, T.LongType()), int32_overflow)
    if isinstance(dtype, T.DoubleType):
        number = f"{found} IN ('BIGINT', 'DOUBLE') OR startswith({found}, 'DECIMAL')"
        return f"IF({number}, {_get(doc, name, 'double')}, NULL)"
    if isinstance(dtype, T.BooleanType):
        return f"IF({found} = 'BOOLEAN', {_get(doc, name, 'boolean')}, NULL)"
    raise ValueError(f"Unsupported data type: {dtype.simpleString()}")


def as_int32(n: str, overflow: str = "null") -> str:
    """A 64-bit integer as 32 bits: null beyond the range, or with "wrap" its low 32 bits."""
    if overflow == "wrap":
        return f"CAST(((({n}) & {2**32 - 1}L) ^ {2**31}L) - {2**31}L AS INT)"
    # A cast that fails would raise and catch an error for every such row.
    return f"IF({n} BETWEEN {-(2**31)} AND {2**31 - 1}, CAST({n} AS INT), NULL)"
