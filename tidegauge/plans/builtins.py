"""Functions and operators of the dialect as Spark SQL: those that Spark names or means otherwise."""

from __future__ import annotations

import re

#: Aggregates that interpolate may stand around.
AGGREGATES = {"avg", "sum", "sum_int", "count", "min", "max", "first", "last", "first_row", "last_row", "stddev", "variance"}
#: Aggregates that gather rows.
AGGREGATES_OF_ROWS = {"array_agg", "json_agg", "jsonb_agg", "string_agg", "concat_agg"}
#: Python functions by the name they are registered with: (module, function).
PYTHON = {
    "tidegauge_json_contains": ("jsonb", "contains"), "tidegauge_json_has_any": ("jsonb", "has_any"), "tidegauge_json_has_all": ("jsonb", "has_all"),
    "tidegauge_json_remove": ("jsonb", "remove"), "tidegauge_json_pretty": ("jsonb", "pretty"), "tidegauge_crc32c": ("scalar", "crc32c"),
    "tidegauge_fnv32": ("scalar", "fnv32"), "tidegauge_fnv32a": ("scalar", "fnv32a"), "tidegauge_fnv64": ("scalar", "fnv64"), "tidegauge_fnv64a": ("scalar", "fnv64a"),
}
#: Letters of strptime formats and the same as Spark's patterns.
TIME_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "p": "a", "I": "hh", "z": "xx", "%": "%"}
#: English names of digits.
DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
#: Types as the dialect names them.
TYPE_NAMES = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "boolean": "bool", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytes"}
#: Microseconds of the parts of a duration.
DURATION_PARTS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def raw(text: str) -> str:
    """A literal whose backslashes Spark leaves alone."""
    if "'" not in text:
        return f"r'{text}'"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unquoted(literal: str) -> str:
    if not re.fullmatch(r"(?s)'.*'", literal.strip()):
        raise ValueError(f"a literal is needed here, not {literal}")
    return literal.strip()[1:-1].replace("''", "'")


def _raise(bad: str, message: str) -> str:
    return f"WHEN {bad} THEN raise_error('{message}')"


def _log(x: str, value: str) -> str:
    return f"CASE {_raise(f'({x}) = 0', 'cannot take logarithm of zero')} {_raise(f'({x}) < 0', 'cannot take logarithm of a negative number')} ELSE {value} END"


def _range(start: str, stop: str, step: str = "1") -> str:
    """Numbers from start to stop, none if the step leads away."""
    return f"CASE WHEN (({step}) > 0 AND ({start}) <= ({stop})) OR (({step}) < 0 AND ({start}) >= ({stop})) THEN sequence(CAST({start} AS BIGINT), CAST({stop} AS BIGINT), CAST({step} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def _regexp_once(x: str, pattern: str, by: str, flags: str = "''") -> str:
    """The first match is replaced, or all with the flag g."""
    flags, by = unquoted(flags), raw(re.sub(r"\\(\d)", r"$\1", unquoted(by)))
    pattern = raw(("(?i)" if "i" in flags else "") + unquoted(pattern))
    if "g" in flags:
        return f"regexp_replace({x}, {pattern}, {by})"
    at = f"regexp_instr({x}, {pattern})"
    return f"CASE WHEN {at} = 0 THEN {x} ELSE concat(substr({x}, 1, {at} - 1), regexp_replace(regexp_substr({x}, {pattern}), {pattern}, {by}), substr({x}, {at} + length(regexp_substr({x}, {pattern})))) END"


def _like(x: str, pattern: str, escape: str, kind: str) -> str:
    return f"({x} {kind} {pattern}" + (f" ESCAPE {escape})" if unquoted(escape) else ")")


def _similar(x: str, pattern: str, escape: str, no: str = "") -> str:
    from ..functions.scalar import similar_regex

    return f"({x} {no}RLIKE {raw(similar_regex(unquoted(pattern), unquoted(escape)))})"


def _strptime(text: str, form: str) -> str:
    return f"to_timestamp({text}, '{_pattern(form)}')"


def _pattern(form: str) -> str:
    def one(m):
        if m[1] not in TIME_LETTERS:
            raise ValueError(f"no such letter of a time format: %{m[1]}")
        return TIME_LETTERS[m[1]]

    return re.sub(r"%(.)", one, re.sub(r"(?<![%A-Za-z])[A-Za-z]+", lambda m: f"\\'{m[0]}\\'", unquoted(form)))


def _object(*args: str) -> str:
    pairs = ", ".join(f"'{unquoted(k)}', {v}" for k, v in zip(args[::2], args[1::2], strict=True))
    return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))" if args else "'{}'"


def _items(*args: str) -> str:
    each = ", ".join(f"substr(to_json(array({a})), 2, length(to_json(array({a}))) - 2)" for a in args)
    return f"concat('[', concat_ws(',', {each}), ']')" if args else "'[]'"


def _typeof(x: str) -> str:
    return f"CASE typeof({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items()) + f" ELSE typeof({x}) END"


def _english(n: str) -> str:
    names = ", ".join(f"'{d}'" for d in DIGITS)
    return f"concat(CASE WHEN ({n}) < 0 THEN 'minus-' ELSE '' END, array_join(transform(split(CAST(abs({n}) AS STRING), ''), __d -> element_at(array({names}), CAST(__d AS INT) + 1)), '-'))"


def _duration(part: str, span: str) -> str:
    unit = unquoted(part).lower().rstrip("s") if part.startswith("'") else part.lower().rstrip("s")
    if unit not in DURATION_PARTS:
        raise ValueError(f"no such part of a duration: {part}")
    micros = f"unix_micros(timestamp_micros(0) + ({span}))"
    return f"({micros} {'/' if unit in ('second', 'millisecond') else 'div'} {DURATION_PARTS[unit]})"


def _age(a: str, b: str = "current_timestamp()") -> str:
    """The span between two times; of one time, the span from it until now."""
    return f"({a} - {b})" if b != "current_timestamp()" else f"({b} - {a})"


def _subscripts(a: str, d: str = "1") -> str:
    return f"explode({_range('1', f'CASE WHEN ({d}) = 1 THEN size({a}) ELSE 0 END')})"


TEMPLATES = {
    "ln": lambda x: _log(x, f"ln({x})"),
    "log": lambda *a: _log(a[-1], f"ln({a[-1]}) / ln({a[0]})" if len(a) > 1 else f"log10({a[0]})"),
    "sqrt": lambda x: f"CASE {_raise(f'({x}) < 0', 'cannot take square root of a negative number')} ELSE sqrt({x}) END",
    "pow": lambda x, y: f"power({x}, {y})",
    "trunc": lambda x, n="0": f"(CASE WHEN ({x}) >= 0 THEN floor(({x}) * power(10, {n})) ELSE ceil(({x}) * power(10, {n})) END / power(10, {n}))",
    "random": lambda: "rand()",
    "to_hex": lambda x: f"lower(hex({x}))",
    "to_english": _english,
    "convert_from": lambda b, e: f"decode({b}, {_encoding(e)})",
    "convert_to": lambda s, e: f"encode({s}, {_encoding(e)})",
    "quote_literal": lambda x: f"concat('\\'', replace({x}, '\\'', '\\'\\''), '\\'')",
    "quote_ident": lambda x: f"CASE WHEN {x} RLIKE '^[a-z_][a-z0-9_]*$' THEN {x} ELSE concat('\"', replace({x}, '\"', '\"\"'), '\"') END",
    "strpos": lambda s, x: f"locate({x}, {s})",
    "regexp_extract": lambda s, p: f"regexp_substr({s}, {raw(unquoted(p))})",
    "regexp_replace": _regexp_once,
    "like_escape": lambda x, p, e: _like(x, p, e, "LIKE"),
    "not_like_escape": lambda x, p, e: _like(x, p, e, "NOT LIKE"),
    "ilike_escape": lambda x, p, e: _like(x, p, e, "ILIKE"),
    "not_ilike_escape": lambda x, p, e: _like(x, p, e, "NOT ILIKE"),
    "similar_to_escape": lambda x, p, e: _similar(x, p, e),
    "not_similar_to_escape": lambda x, p, e: _similar(x, p, e, "NOT "),
    "pg_typeof": _typeof,
    "annotate_type": lambda x, kind: f"CAST({x} AS {unquoted(kind)})",
    "crc32ieee": lambda x: f"crc32(CAST({x} AS BINARY))",
    "sha256": lambda x: f"sha2({x}, 256)",
    "sha512": lambda x: f"sha2({x}, 512)",
    "extract_duration": _duration,
    "age": _age,
    "timezone": lambda zone, ts: f"from_utc_timestamp({ts}, {zone})",
    "timeofday": lambda: "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss.SSSSSS yyyy xx')",
    "localtime": lambda: "date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')",
    "clock_timestamp": lambda: "current_timestamp()",
    "statement_timestamp": lambda: "current_timestamp()",
    "transaction_timestamp": lambda: "current_timestamp()",
    "experimental_strptime": _strptime,
    "strptime": _strptime,
    "experimental_strftime": lambda ts, form: f"date_format({ts}, '{_pattern(form)}')",
    "count_rows": lambda: "count(*)",
    "sum_int": lambda x: f"CAST(sum({x}) AS BIGINT)",
    "xor_agg": lambda x: f"bit_xor({x})",
    "any_not_null": lambda x: f"any_value({x}, true)",
    "sqrdiff": lambda x: f"(var_pop({x}) * count({x}))",
    "array_length": lambda a, d="1": f"CASE WHEN ({d}) = 1 AND size({a}) > 0 THEN size({a}) END",
    "array_lower": lambda a, d="1": f"CASE WHEN ({d}) = 1 AND size({a}) > 0 THEN 1 END",
    "array_upper": lambda a, d="1": f"CASE WHEN ({d}) = 1 AND size({a}) > 0 THEN size({a}) END",
    "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_cat": lambda a, b: f"concat({a}, {b})",
    "array_position": lambda a, x: f"nullif(array_position({a}, {x}), 0)",
    "array_positions": lambda a, x: f"filter(transform({a}, (__v, __i) -> CASE WHEN __v <=> {x} THEN __i + 1 END), __v -> __v IS NOT NULL)",
    "array_replace": lambda a, x, y: f"transform({a}, __v -> CASE WHEN __v <=> {x} THEN {y} ELSE __v END)",
    "array_to_string": lambda a, *s: f"array_join({', '.join([a, *s])})",
    "string_to_array": lambda s, x: f"split({s}, {raw('[' + unquoted(x) + ']' if len(unquoted(x)) == 1 and unquoted(x) not in '^]' else re.escape(unquoted(x)))})",
    "unnest": lambda a: f"explode({a})",
    "_pg_expandarray": lambda a: f"inline(transform({a}, (__v, __i) -> named_struct('x', __v, 'n', __i + 1)))",
    "generate_series": lambda *a: f"explode({_range(*a)})",
    "generate_subscripts": _subscripts,
    "jsonb_array_elements": lambda j: f"explode(transform(variant_get(parse_json({j}), '$', 'array<variant>'), __v -> to_json(__v)))",
    "jsonb_array_elements_text": lambda j: f"explode(transform(variant_get(parse_json({j}), '$', 'array<variant>'), __v -> variant_get(__v, '$', 'string')))",
    "jsonb_object_keys": lambda j: f"explode(array_sort(json_object_keys({j})))",
    "jsonb_array_length": lambda j: f"json_array_length({j})",
    "jsonb_typeof": lambda j: f"CASE substr(trim({j}), 1, 1) WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE CASE WHEN {j} IS NOT NULL THEN 'number' END END",
    "jsonb_build_object": _object,
    "jsonb_build_array": _items,
    "jsonb_pretty": lambda j: f"tidegauge_json_pretty({j})",
    "gen_random_uuid": lambda: "uuid()",
    "uuid_v4": lambda: "CAST(unhex(replace(uuid(), '-', '')) AS BINARY)",
    "experimental_uuid_v4": lambda: "CAST(unhex(replace(uuid(), '-', '')) AS BINARY)",
    "unique_rowid": lambda: "monotonically_increasing_id()",
    **{name: (lambda f: lambda x: f"tidegauge_{f}({x})")(name) for name in ("crc32c", "fnv32", "fnv32a", "fnv64", "fnv64a")},
}
TEMPLATES |= {name.replace("jsonb_", "json_"): f for name, f in TEMPLATES.items() if name.startswith("jsonb_")}


def _encoding(literal: str) -> str:
    """Names of encodings, without regard to case, dashes and underscores."""
    name = re.sub(r"[-_\s]", "", unquoted(literal)).upper()
    known = {"UTF8": "'UTF-8'", "LATIN1": "'ISO-8859-1'", "ISO88591": "'ISO-8859-1'"}
    if name not in known:
        raise ValueError(f"invalid source encoding name {literal}")
    return known[name]


def call(name: str, args: list[str]) -> str | None:
    """Spark SQL of a call, or None where Spark's own function is meant."""
    return TEMPLATES[name](*[a.strip() for a in args]) if name in TEMPLATES else None


def _path(right: str) -> str:
    """A path literal '{a,1}' or array('a', 'b') as a JSON path."""
    inner = re.fullmatch(r"(?is)array\((.*)\)", right)
    steps = [unquoted(x) for x in inner[1].split(",")] if inner else unquoted(right).strip("{}").split(",")
    return "$" + "".join(_step(s.strip()) for s in steps if s.strip())


def _step(key: str) -> str:
    return f"[{key}]" if key.isdigit() else "['" + key.replace("'", "\\'") + "']"


def json_operator(op: str, left: str, right: str) -> tuple[str, set[str]]:
    """Spark SQL of a JSON or array operator, and the Python functions that it needs."""
    arrays = bool(re.match(r"(?i)array\(", left.strip()) or re.match(r"(?i)array\(", right))
    if op in ("->", "->>", "#>", "#>>"):
        path = _path(right) if op[0] == "#" else "$" + (f"[{right}]" if right.isdigit() else _step_of_key(right))
        path = path.replace("\\", "\\\\").replace("'", "\\'")
        if op.endswith(">>"):
            return f"variant_get(parse_json({left}), '{path}', 'string')", set()
        return f"to_json(variant_get(parse_json({left}), '{path}', 'variant'))", set()
    if op == "#-":
        inner = re.fullmatch(r"(?is)array\((.*)\)", right)
        steps = right if inner else "array(" + ", ".join(f"'{s.strip()}'" for s in unquoted(right).strip("{}").split(",")) + ")"
        return f"tidegauge_json_remove({left}, {steps})", {"tidegauge_json_remove"}
    if op == "&&":
        return f"arrays_overlap({left}, {right})", set()
    if op in ("@>", "<@"):
        big, small = (left, right) if op == "@>" else (right, left)
        if arrays:
            return f"(size(array_except({small}, {big})) = 0)", set()
        return f"tidegauge_json_contains({big}, {small})", {"tidegauge_json_contains"}
    keys = right if arrays else f"array({right})"
    name = "tidegauge_json_has_all" if op == "?&" else "tidegauge_json_has_any"
    return f"{name}({left}, {keys})", {name}


def _step_of_key(right: str) -> str:
    """A key is a key even if it has only digits."""
    return "['" + unquoted(right).replace("'", "\\'") + "']"
