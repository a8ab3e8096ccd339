"""Rule sets and graders as SQL functions of the session catalog.

``register(spark)`` creates temporary SQL functions: scalars for the fields of a sample and for answers, rule sets
that give an array of errors, and ``grade``, which takes the name of a grader from the catalog row.  They are
expressions that Catalyst inlines where they are called, so a query in plain SQL has the plan of the DataFrame
operators, without Python.  A body that uses a JSON value several times takes it through a lambda (``call``): a filter that
Catalyst infers from it and pushes down (an inner join's key is not null, an exploded array not empty) would else hold
the parse of the text once for every use:

    SELECT task, line, inline(errors) FROM (SELECT task, line, sample_errors(text) AS errors FROM samples)
    SELECT avg(grade(c.grader, g.output, b.doc, c.answer_field, c.solution_field)) FROM ...

Rule sets are no table functions: Spark plans one over a column of the row (LATERAL) as a join of the rows with
themselves by their texts.  Values and steps are those of ``functions.mathnorm``, ``functions.variant`` and ``operators.validate``; NULL stands for
"the reference would raise here".
"""
from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..operators.validate import MIN_MAX_MODEL_LEN, REQUIRED_MAX_GEN_TOKS, REQUIRED_NONEMPTY
from .mathnorm import A_SLASH_B, HALF, REPLACEMENTS_AFTER_UNITS, REPLACEMENTS_BEFORE_UNITS, UNITS_MARKER
from .text import PY_WHITESPACE

GRADERS = ("reference", "fixed")  # names a catalog row may give


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def at(path: str, v: str = "v", kind: str = "variant") -> str:
    return f"try_variant_get({v}, {lit('$' + path)}, '{kind}')"


def replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


def error(cond: str, code: str, detail: str = "CAST(NULL AS STRING)") -> str:
    return f"CASE WHEN {cond} THEN named_struct('code', '{code}', 'detail', {detail}) END"


def rules(*errors: str) -> str:
    return f"if(v IS NULL, array(named_struct('code', 'parse_error', 'detail', CAST(NULL AS STRING))), array_compact(array({', '.join(errors)})))"


def blank_field(name: str) -> str:
    """Missing, null or blank; other JSON values have a text that is not blank."""
    return f"coalesce(trim(BOTH {lit(PY_WHITESPACE)} FROM {at('.' + name, kind='string')}), '') = ''"


PIECES = "slice(p, 2, greatest(size(p) - 1, 1))"  # what follows the first separator
JSON: dict[str, tuple[str, ...]] = {}  # parameters and body of the functions of JSON values


def define(name: str, args: str, returns: str, body: str) -> tuple[str, str, str, str]:
    """A function whose arguments are evaluated once each, wherever it is inlined."""
    names = tuple(re.findall(r"(?:^|, )([a-z]\w*) ", args))
    JSON[name] = (*names, body)
    return name, args, returns, call(name, *names)


def call(name: str, *args: str) -> str:
    """A function of ``JSON`` applied to expressions, in built-in functions only: lambdas can't call SQL functions."""
    *names, text = JSON[name]
    for param, arg in zip(reversed(names), reversed(args), strict=True):
        text = f"get(transform(array({arg}), {param} -> {text}), 0)"
    return text


def none(x: str) -> str:
    return f"({x} IS NULL OR is_variant_null({x}))"


def stripped(x: str) -> str:
    return f"trim(BOTH {lit(PY_WHITESPACE)} FROM {x})"


def blank(x: str) -> str:
    return f"coalesce(trim(LEADING {lit(PY_WHITESPACE)} FROM {x}) = '', true)"


FRACTION = """CASE WHEN left(x, 1) = '{' THEN x
  WHEN substring(x, 2, 1) <> '{' THEN concat('{', left(x, 1), '}{', substring(x, 2, 1), '}', substring(x, 3))
  ELSE concat('{', left(x, 1), '}', substring(x, 2)) END"""

SCALARS: list[tuple[str, str, str, str]] = [
    # texts
    ("py_strip", "s STRING", "STRING", stripped("s")),
    ("is_blank", "s STRING", "BOOLEAN", blank("s")),
    ("content_hash", "s STRING", "STRING", "substring(sha2(s, 256), 1, 16)"),
    ("whitespace_tokens", "s STRING", "BIGINT",
     f"CAST(coalesce(regexp_count(concat(' ', translate(s, {lit(PY_WHITESPACE)}, {lit(' ' * len(PY_WHITESPACE))})), ' [^ ]'), 0) AS BIGINT)"),
    # JSON values
    ("json_is_none", "v VARIANT", "BOOLEAN", "v IS NULL OR is_variant_null(v)"),
    define("json_text", "v VARIANT", "STRING", """CASE WHEN v IS NULL THEN NULL WHEN schema_of_variant(v) = 'VOID' THEN 'None'
       WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string')
       WHEN schema_of_variant(v) = 'BOOLEAN' THEN if(try_variant_get(v, '$', 'boolean'), 'True', 'False') ELSE to_json(v) END"""),
    define("json_truthy", "v VARIANT", "BOOLEAN", f"""CASE WHEN {none('v')} THEN false
       WHEN schema_of_variant(v) = 'BOOLEAN' THEN try_variant_get(v, '$', 'boolean')
       WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') <> ''
       WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN {at('[0]')} IS NOT NULL
       WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN schema_of_variant(v) <> 'OBJECT<>'
       ELSE coalesce(try_variant_get(v, '$', 'double') <> 0, true) END"""),
    define("json_equals", "v VARIANT, n DOUBLE", "BOOLEAN",
     "coalesce(schema_of_variant(v) RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)' AND try_variant_get(v, '$', 'double') = n, false)"),
    define("number_key", "v VARIANT, d DOUBLE, whole DECIMAL(38, 0)", "STRING",
     "concat('n:', if((schema_of_variant(v) RLIKE '^(TINYINT|SMALLINT|INT|BIGINT)' OR d = floor(d)) AND whole IS NOT NULL, CAST(whole AS STRING), CAST(d AS STRING)))"),
    define("typed_key", "v VARIANT", "STRING", f"""CASE WHEN schema_of_variant(v) = 'BOOLEAN' THEN concat('n:', CAST(CAST(try_variant_get(v, '$', 'boolean') AS INT) AS STRING))
       WHEN schema_of_variant(v) RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)' THEN {call('number_key', 'v', "try_variant_get(v, '$', 'double')", "try_variant_get(v, '$', 'decimal(38,0)')")}
       WHEN schema_of_variant(v) = 'STRING' THEN concat('s:', try_variant_get(v, '$', 'string')) ELSE concat('j:', to_json(v)) END"""),
    # fields of a sample
    define("first_output", "v VARIANT", "STRING", f"""CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' AND schema_of_variant({at('[0]')}) LIKE 'ARRAY%' AND {at('[0][0]')} IS NOT NULL
         THEN {call('json_text', at('[0][0]'))}
       WHEN schema_of_variant(v) LIKE 'ARRAY%' AND schema_of_variant({at('[0]')}) = 'STRING' THEN {at('[0]', kind='string')} END"""),
    define("sample_output", "v VARIANT", "STRING", f"coalesce({call('first_output', at('.resps'))}, {call('first_output', at('.filtered_resps'))}, '')"),
    define("first_group", "m MAP<STRING, VARIANT>", "VARIANT", "coalesce(try_element_at(m, 'gen_args_0'), try_element_at(m, array_min(map_keys(m))))"),
    define("sample_prompt", "v VARIANT", "STRING", f"""coalesce(
       {call('json_text', call('first_group', f"map_filter(transform_values(try_cast({at('.arguments')} AS MAP<STRING, VARIANT>), (k, g) -> {at('.arg_0', 'g')}), (k, x) -> x IS NOT NULL AND NOT is_variant_null(x))"))},
       {call('first_output', at('.arguments'))}, CASE WHEN NOT {none(at('.prompt'))} THEN {call('json_text', at('.prompt'))} END, '')"""),
    define("sample_doc_id", "v VARIANT, line BIGINT", "VARIANT",
     f"CASE WHEN NOT {none(at('.doc_id'))} THEN {at('.doc_id')} WHEN NOT {none(at('.id'))} THEN {at('.id')} ELSE CAST(line AS VARIANT) END"),
    ("doc_field", "doc VARIANT, name STRING", "VARIANT", "try_element_at(try_cast(doc AS MAP<STRING, VARIANT>), name)"),
    # answers
    ("last_at", "s STRING, what STRING", "INT", "CASE WHEN instr(reverse(s), reverse(what)) = 0 THEN 0 ELSE length(s) - instr(reverse(s), reverse(what)) - length(what) + 2 END"),
    ("dollar_span", "s STRING", "STRING",
     "CASE WHEN length(s) - length(replace(s, '$', '')) <= 1 THEN s ELSE substring(s, instr(s, '$') + 1, last_at(s, '$') - instr(s, '$') - 1) END"),
    ("closing_brace", "s STRING", "INT", """aggregate(split(s, ''), named_struct('d', 0, 'i', 0, 'e', -1), (a, x) -> CASE WHEN a.e >= 0 THEN a ELSE
       named_struct('d', a.d + CASE x WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, 'i', a.i + 1, 'e', if(x = '}' AND a.d = 1, a.i, -1)) END, a -> a.e)"""),
    ("through_brace", "s STRING", "STRING", "CASE WHEN closing_brace(s) >= 0 THEN left(s, closing_brace(s) + 1) END"),
    ("last_boxed", "s STRING", "STRING", r"""CASE WHEN instr(s, '\\boxed ') > 0 THEN concat('\\boxed ', substring_index(substring_index(s, '\\boxed ', -1), '$', 1))
       WHEN last_at(s, '\\boxed') > 0 THEN through_brace(substring(s, last_at(s, '\\boxed')))
       WHEN last_at(s, '\\fbox') > 0 THEN through_brace(substring(s, last_at(s, '\\fbox'))) END"""),
    ("remove_boxed", "s STRING", "STRING", r"""CASE WHEN instr(s, '\\boxed ') > 0 THEN CASE WHEN startswith(s, '\\boxed ') THEN substring(s, 8) END
       WHEN NOT startswith(s, '\\boxed{') THEN s WHEN endswith(s, '}') THEN substring(s, 8, length(s) - 8) END"""),
    ("boxed_answer", "s STRING", "STRING", "remove_boxed(last_boxed(s))"),
    ("cut_units", "s STRING", "STRING", f"CASE size(split(s, {lit(UNITS_MARKER.replace(chr(92), chr(92) * 2).replace('{', chr(92) + '{'))}, -1)) WHEN 1 THEN s WHEN 2 THEN substring_index(s, {lit(UNITS_MARKER)}, 1) END"),
    ("lead_zero", "s STRING", "STRING", "if(left(s, 1) = '.', concat('0', s), s)"),
    ("right_of_equals", "s STRING", "STRING", "if(size(split(s, '=', -1)) = 2 AND length(split(s, '=', -1)[0]) <= 2, split(s, '=', -1)[1], s)"),
    ("join_roots", "s STRING, p ARRAY<STRING>", "STRING", rf"""CASE WHEN size(p) <= 1 THEN s WHEN exists({PIECES}, x -> x = '') THEN NULL
       ELSE concat(p[0], array_join(transform({PIECES}, x -> if(left(x, 1) <> '{{', concat('\\sqrt{{', left(x, 1), '}}', substring(x, 2)), concat('\\sqrt', x))), '')) END"""),
    ("fix_roots", "s STRING", "STRING", r"join_roots(s, split(s, '\\\\sqrt', -1))"),
    ("join_fractions", "s STRING, p ARRAY<STRING>, bad STRING", "STRING", rf"""CASE WHEN size(p) <= 1 THEN s
       WHEN bad IS NULL THEN array_join(concat(array(p[0]), transform({PIECES}, x -> {FRACTION})), '\\frac') WHEN bad = '' THEN NULL ELSE s END"""),
    ("first_bad", "p ARRAY<STRING>", "STRING", f"get(filter({PIECES}, x -> x = '' OR (length(x) = 1 AND x <> '{{')), 0)"),
    ("fix_fractions", "s STRING", "STRING", r"join_fractions(s, split(s, '\\\\frac', -1), first_bad(split(s, '\\\\frac', -1)))"),
    ("half", "s STRING", "STRING", f"if(s = '0.5', {lit(HALF)}, s)"),
    ("slash", "s STRING", "STRING", f"regexp_replace(s, {lit(A_SLASH_B)}, {lit(chr(92) * 2 + 'frac{$1}{$2}')})"),
    ("strip_answer", "s STRING", "STRING",
     f"slash(half(fix_fractions(replace(fix_roots(right_of_equals(lead_zero({replaced(f'cut_units({replaced(chr(115), REPLACEMENTS_BEFORE_UNITS)})', REPLACEMENTS_AFTER_UNITS)}))), ' ', ''))))"),
    ("same_answer", "a STRING, b STRING, na STRING, nb STRING", "BOOLEAN", """CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false
       WHEN na IS NULL OR nb IS NULL THEN a = b ELSE na = nb END"""),
    ("is_equivalent", "a STRING, b STRING", "BOOLEAN", "same_answer(a, b, strip_answer(a), strip_answer(b))"),
    # graders: answer of the output, gold of the document, verdict
    ("gold_answer", "answer VARIANT, solution VARIANT", "STRING",
     "CASE WHEN NOT json_is_none(answer) THEN json_text(answer) WHEN json_truthy(solution) THEN boxed_answer(json_text(solution)) END"),
    ("grade_reference", "output STRING, doc VARIANT", "INT", f"""if(coalesce(json_is_none({at('.answer', 'doc')}) OR schema_of_variant({at('.answer', 'doc')}) = 'STRING', false)
       AND gold_answer({at('.answer', 'doc')}, {at('.solution', 'doc')}) IS NOT NULL
       AND is_equivalent(dollar_span(output), gold_answer({at('.answer', 'doc')}, {at('.solution', 'doc')})), 1, 0)"""),
    ("grade_fixed", "output STRING, gold STRING", "INT", "if(gold IS NOT NULL AND is_equivalent(coalesce(boxed_answer(output), dollar_span(output)), gold), 1, 0)"),
    ("grade", "grader STRING, output STRING, doc VARIANT, answer_field STRING, solution_field STRING", "INT",
     "CASE grader WHEN 'reference' THEN grade_reference(output, doc) WHEN 'fixed' THEN grade_fixed(output, gold_answer(doc_field(doc, answer_field), doc_field(doc, solution_field))) END"),
]

ERRORS = "ARRAY<STRUCT<code: STRING, detail: STRING>>"
RULE_SETS: list[tuple[str, str, str, str]] = [
    define("sample_rules", "v VARIANT", ERRORS, rules(
        error(blank(call('sample_output', 'v')), "empty_output"),
        error(f"{none(at('.resps'))} AND {none(at('.filtered_resps'))}", "missing_resps"),
        error(f"{call('sample_prompt', 'v')} = '' AND {none(at('.doc'))}", "missing_prompt"))),
    ("sample_errors", "text STRING", ERRORS, call("sample_rules", f"try_parse_json({stripped('text')})")),
    define("export_rules", "v VARIANT, method STRING", ERRORS, rules(
        *[error(blank_field(name), "empty_field", lit(name)) for name in REQUIRED_NONEMPTY],
        error(none(at('.doc_id')), "missing_doc_id"),
        error("NOT array_contains(map_keys(try_cast(v AS MAP<STRING, VARIANT>)), 'gold_answer')", "missing_gold_answer"),
        error(f"NOT {call('json_equals', at('.max_gen_toks'), f'CAST({REQUIRED_MAX_GEN_TOKS} AS DOUBLE)')}", "bad_max_gen_toks", call('json_text', at('.max_gen_toks'))),
        error(f"floor(coalesce({at('.max_model_len', kind='double')}, 0)) < {MIN_MAX_MODEL_LEN}", "short_max_model_len"),
        error(f"floor(coalesce({at('.output_token_count', kind='double')}, 0)) <= 0", "bad_output_token_count"),
        error(f"coalesce({at('.output_token_count_method', kind='string')}, '') <> method", "bad_token_method", f"coalesce({at('.output_token_count_method', kind='string')}, '')"))),
    ("export_errors", "text STRING, method STRING", ERRORS, call("export_rules", f"try_parse_json({stripped('text')})", "method")),
]


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session; returns their names."""
    for name, args, returns, body in [*SCALARS, *RULE_SETS]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return [name for name, *_ in [*SCALARS, *RULE_SETS]]
