"""Column functions over polymorphic JSON held as ``VARIANT``.

Raw rows and generation samples are parsed once into a ``VARIANT`` column
(``try_parse_json``); every extraction below is a type-guarded built-in
expression, so nothing leaves the JVM and no schema is ever inferred (a mixed
``resps`` column would otherwise degrade to STRING).

Every accessor addresses the *root* column with one JSON path
(``$['resps'][0][0]``) instead of chaining accessors, so expression trees stay
shallow (chained accessors re-expand inside every CASE branch and blow up
code generation).  Non-emptiness of a list is "element 0 exists", which
avoids copying the list.

``schema_of_variant`` names: JSON null is ``VOID``; a missing key is SQL NULL.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field-priority lists of the raw SFT row (first truthy wins).
PROBLEM_FIELDS = ("question", "problem", "query", "input", "instruction", "prompt")
COMPLETION_FIELDS = ("solution", "response", "output", "completion", "rationale", "reasoning")
# Where a generation sample keeps its outputs, in lookup order.
OUTPUT_KEYS = ("resps", "filtered_resps")

_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key(name: str) -> str:
    """Path step for an object key."""
    return "['" + name.replace("'", "\\'") + "']"


def at(v, path: str = "") -> Column:
    """The value at ``$<path>`` as VARIANT; SQL NULL when absent or of the wrong shape."""
    return F.try_variant_get(_c(v), "$" + path, "variant")


def vtype(v, path: str = "") -> Column:
    return F.schema_of_variant(at(v, path)) if path else F.schema_of_variant(_c(v))


def as_string(v, path: str = "") -> Column:
    return F.try_variant_get(_c(v), "$" + path, "string")


def is_none(v, path: str = "") -> Column:
    """Python ``x is None`` after ``dict.get``: missing or JSON null."""
    x = at(v, path) if path else _c(v)
    return x.isNull() | F.is_variant_null(x)


def is_list(v, path: str = "") -> Column:
    return F.coalesce(vtype(v, path).startswith("ARRAY"), F.lit(False))


def is_str(v, path: str = "") -> Column:
    return F.coalesce(vtype(v, path) == "STRING", F.lit(False))


def nonempty_list(v, path: str = "") -> Column:
    return is_list(v, path) & at(v, path + "[0]").isNotNull()


def as_map(v, path: str = "") -> Column:
    """The object as ``MAP<STRING, VARIANT>``; NULL for anything that is not an object."""
    return (at(v, path) if path else _c(v)).try_cast("map<string,variant>")


def truthy(v, path: str = "") -> Column:
    """Python truthiness of a JSON value: null, "", 0, 0.0, false, [] and {} are falsy."""
    t = vtype(v, path)
    return (F.when(is_none(v, path), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(_c(v), "$" + path, "boolean"))
            .when(t == "STRING", F.length(as_string(v, path)) > 0)
            .when(t.startswith("ARRAY"), at(v, path + "[0]").isNotNull())
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .when(t.rlike(_NUMERIC), F.try_variant_get(_c(v), "$" + path, "double") != 0)
            .otherwise(F.lit(True)))


def py_str(v, path: str = "") -> Column:
    """``str(x)`` of a JSON value: strings as-is, ``None``, ``True``/``False``, numbers as text.

    SQL NULL when absent.  Lists/objects render as JSON text (Python prints
    its repr); documented divergence.
    """
    x = at(v, path) if path else _c(v)
    t = F.schema_of_variant(x)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(t == "VOID", F.lit("None"))
            .when(t == "STRING", F.try_variant_get(x, "$", "string"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), F.lit("True"))
                  .otherwise(F.lit("False")))
            .otherwise(F.to_json(x)))


def first_truthy_text(v, fields: Sequence[str]) -> Column:
    """``str(row.get(f1) or row.get(f2) or ... or "")`` over the given field names.

    The values go through one lambda each for truth and text: spelt out per field, the branches of six fields
    make more generated code than one method may hold."""
    chosen = F.filter(F.array(*[at(v, key(f)) for f in fields]), lambda x: truthy(x))
    return F.coalesce(F.get(F.transform(chosen, lambda x: py_str(x)), 0), F.lit(""))


def _output_from(v, path: str) -> Column:
    """One step of P7 at ``path``: NULL means "fall through to the next key"."""
    first = path + "[0]"
    return (F.when(nonempty_list(v, path) & nonempty_list(v, first), py_str(v, first + "[0]"))
            .when(nonempty_list(v, path) & is_str(v, first), as_string(v, first)))


def extract_output(v, keys: Sequence[str] = OUTPUT_KEYS) -> Column:
    """``resps`` then ``filtered_resps``; ``[[x]]`` -> x, ``[x]`` -> x, otherwise next; else ""."""
    return F.coalesce(*[_output_from(v, key(k)) for k in keys], F.lit(""))


def extract_filtered(v) -> Column:
    """The filtered output on its own (NULL when ``filtered_resps`` is missing/null)."""
    p = key("filtered_resps")
    return F.when(~is_none(v, p), F.coalesce(_output_from(v, p), F.lit("")))


def extract_prompt(v) -> Column:
    """``arguments`` object (``gen_args_0.arg_0``, else first key in sorted order whose
    group has a non-null ``arg_0``), else ``arguments`` list (``[0][0]`` or string ``[0]``),
    else ``prompt``, else ""."""
    a = key("arguments")
    arg0 = F.map_filter(
        F.transform_values(as_map(v, a), lambda k, g: F.try_variant_get(g, "$['arg_0']", "variant")),
        lambda k, x: x.isNotNull() & ~F.is_variant_null(x))
    from_dict = F.coalesce(F.try_element_at(arg0, F.lit("gen_args_0")),
                           F.try_element_at(arg0, F.array_min(F.map_keys(arg0))))
    first = a + "[0]"
    from_list = (F.when(nonempty_list(v, a) & nonempty_list(v, first), py_str(v, first + "[0]"))
                 .when(nonempty_list(v, a) & is_str(v, first), as_string(v, first)))
    p = key("prompt")
    from_prompt = F.when(~is_none(v, p), py_str(v, p))
    return F.coalesce(py_str(from_dict), from_list, from_prompt, F.lit(""))


def extract_doc_id(v, line) -> Column:
    """``doc_id``, else ``id``, else the line number -- as a VARIANT; 0 is a valid id."""
    did, alt = key("doc_id"), key("id")
    return (F.when(~is_none(v, did), at(v, did)).when(~is_none(v, alt), at(v, alt))
            .otherwise(_c(line).cast("bigint").cast("variant")))


def typed_key(v, path: str = "") -> Column:
    """A key that keeps the JSON type, so ``0`` and ``"0"`` differ (Python set semantics).

    Python also treats ``0 == 0.0 == False``: whole numbers of any type and booleans become
    the same decimal text (exact beyond 2**53), and only fractions go through DOUBLE.
    """
    x = at(v, path) if path else _c(v)
    t = F.schema_of_variant(x)
    num = F.try_variant_get(x, "$", "double")
    exact = F.try_variant_get(x, "$", "decimal(38,0)")
    whole = F.rlike(t, F.lit(r"^(TINYINT|SMALLINT|INT|BIGINT)")) | (num == F.floor(num))
    number = F.when(whole & exact.isNotNull(), exact.cast("string")).otherwise(num.cast("string"))
    return (F.when(t == "BOOLEAN", F.concat(F.lit("n:"), F.try_variant_get(x, "$", "boolean").cast("int").cast("string")))
            .when(t.rlike(_NUMERIC), F.concat(F.lit("n:"), number))
            .when(t == "STRING", F.concat(F.lit("s:"), F.try_variant_get(x, "$", "string")))
            .otherwise(F.concat(F.lit("j:"), F.to_json(x))))


def doc_field(v, name_col) -> Column:
    """``doc.get(name)`` where ``doc`` is the sample's ``doc`` object (``{}`` if not an object)
    and ``name`` comes from a column (the per-task catalog field name)."""
    return F.try_element_at(as_map(v, key("doc")), _c(name_col))


def field(v, name: str) -> Column:
    """``obj.get(name)`` as a VARIANT."""
    return at(v, key(name))
