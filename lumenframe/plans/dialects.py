"""SQL text of other dialects as Spark SQL.

The text is cut into tokens and nested by parentheses, and only what Spark reads in
another way is rewritten: quoting and literals, null ordering, types, functions, formats,
subscripts, division, concatenation, table functions, row limits, QUALIFY, DISTINCT ON, star
modifiers, pipe stages and APPLY.  What is left is Spark SQL for Catalyst to plan.
Constructs that plain SQL can't express raise ``ValueError`` with the operator to use, as
Spark would misread some of them.

``types`` (names of columns with Spark types; ``run`` takes them from the tables that a query
names) tell which divisions are of integers and which ``+`` joins texts; without them literals, casts and
functions do, and a division of unknown operands asks ``typeof``.  Columns of ``* REPLACE`` come last.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, similar_pattern
from ..operators import joins
from . import formats

DIALECTS = ("spark", "duckdb", "postgres", "snowflake", "tsql", "bigquery", "mysql", "redshift", "trino", "sqlite")
#: Engines that read another one's dialect.
DERIVED = {"databricks": "spark", "hive": "spark", "mariadb": "mysql", "presto": "trino", "athena": "trino", "starburst": "trino", "sqlserver": "tsql", "fabric": "tsql", "synapse": "tsql", "postgresql": "postgres", "greenplum": "postgres", "materialize": "postgres"}
BACKSLASH = {"spark", "snowflake", "bigquery", "mysql"}
DOUBLE_QUOTED_TEXT = {"spark", "bigquery", "mysql"}
NULLS_LAST = {"duckdb", "trino"}
NULLS_HIGH = {"postgres", "snowflake", "redshift"}
#: Whose ``/`` cuts the quotient of two integers.
INTEGER_DIVISION = {"postgres", "redshift", "tsql", "trino", "sqlite"}
INTEGRAL = {"tinyint", "smallint", "int", "integer", "bigint", "byte", "short", "long"}
INTEGRAL_CALLS = {"COUNT", "LENGTH", "CHAR_LENGTH", "LEN", "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "SIZE", "CARDINALITY", "DATEDIFF", "DATEPART", "INSTR", "STRPOS", "COUNT_BIG"}
FRACTIONAL_CALLS = {"AVG", "SQRT", "LN", "EXP", "STDDEV", "STDDEV_SAMP", "VAR_SAMP", "POWER", "SIN", "COS"}
TEXT_CALLS = {"CONCAT", "UPPER", "LOWER", "SUBSTRING", "LTRIM", "RTRIM", "TRIM", "REPLACE", "LEFT", "RIGHT", "STR", "CHAR", "STUFF", "FORMAT", "QUOTENAME"}
#: Whose CONCAT passes over nulls, and whose GREATEST and LEAST are null if an argument is.
SKIPS_NULLS = {"duckdb", "postgres", "tsql", "sqlite"}
NULL_IF_ANY = {"snowflake", "bigquery", "mysql", "trino"}
LITERAL_SPLITS = {("duckdb", "STRING_SPLIT"), ("duckdb", "STR_SPLIT"), ("postgres", "STRING_TO_ARRAY"), ("snowflake", "SPLIT"), ("bigquery", "SPLIT"), ("trino", "SPLIT")}
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "FETCH")
ORDER_ENDS = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "SEPARATOR", "UNION", "INTERSECT", "EXCEPT", "QUALIFY"}
#: Words that Spark would misread, where (tokens before and after), and what to use instead.
REFUSED = {d: {
    "CONNECT": (lambda _, after: _is(after, "BY"), "operators.relations.connect_by"),
    "SAMPLE": (lambda before, after: isinstance(after, Group) or _is(before, "USING"), "DataFrame.sample"),
    "PIVOT": (lambda before, after, d=d: d == "duckdb" and not isinstance(after, Group), "operators.shape.pivot"),
    "%": (lambda before, after, d=d: d == "duckdb" and (after is None or _is(after, "OFFSET")), "operators.shape.top_percent"),
    "PERCENT": (lambda before, after, d=d: d == "duckdb" and isinstance(before, str) and before.replace(".", "").isdigit(), "operators.shape.top_percent"),
    "OPENXML": (lambda _, after: isinstance(after, Group), "operators.shape.xml_nodes"),
    "OPENQUERY": (lambda _, after: isinstance(after, Group), "a reader of the linked source"),
    "GRAPH_TABLE": (lambda _, after: isinstance(after, Group), "operators.relations.Graph.match"),
    "CHANGES": (lambda _, after: isinstance(after, Group), "a table format with a changelog"),
} for d in ("duckdb", "postgres", "snowflake", "tsql", "bigquery", "mysql", "redshift", "trino", "sqlite")}
ELSEWHERE = {"ASOF": "operators.joins.asof_join", "POSITIONAL": "operators.joins.positional_join", "MATCH_RECOGNIZE": "operators.relations.match_recognize", "GROUPS": "operators.shape.groups_frame"}
TYPES = {
    "TEXT": "STRING", "VARCHAR": "STRING", "NVARCHAR": "STRING", "NCHAR": "STRING", "CHAR": "STRING", "INTEGER": "INT", "REAL": "FLOAT", "DATETIMEOFFSET": "TIMESTAMP", "SMALLDATETIME": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "VARBINARY": "BINARY", "BYTEA": "BINARY", "BLOB": "BINARY", "UNSIGNED": "BIGINT", "SIGNED": "BIGINT", "MONEY": "DECIMAL(19,4)", "BIGNUMERIC": "DECIMAL(38,18)", "UUID": "STRING", "JSON": "STRING", "CHARACTER": "STRING", "INT64": "BIGINT", "INT8": "BIGINT", "INT4": "INT", "INT2": "SMALLINT", "FLOAT64": "DOUBLE",
    "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "NUMBER": "DECIMAL(38,0)", "NUMERIC": "DECIMAL(38,9)", "DATETIME": "TIMESTAMP_NTZ", "DATETIME2": "TIMESTAMP_NTZ", "BOOL": "BOOLEAN", "BIT": "BOOLEAN", "BYTES": "BINARY", "HUGEINT": "DECIMAL(38,0)",
}
#: Functions that only have another name in Spark.
NAMES = {
    "tsql": {"ISNULL": "coalesce", "GETDATE": "current_timestamp", "CHARINDEX": "locate", "IIF": "if", "REPLICATE": "repeat", "STDEV": "stddev_samp", "VAR": "var_samp", "CEILING": "ceil", "NEWID": "uuid", "DATALENGTH": "octet_length", "SYSDATETIME": "current_timestamp", "CHOOSE": "elt", "EOMONTH": "last_day", "VARP": "var_pop", "STDEVP": "stddev_pop", "ATN2": "atan2", "COUNT_BIG": "count"},
    "snowflake": {"IFF": "if", "BOOLAND_AGG": "bool_and", "BOOLOR_AGG": "bool_or", "EDITDISTANCE": "levenshtein", "ARRAY_SIZE": "size", "ARRAY_CONSTRUCT": "array", "RLIKE": "regexp_like", "TO_VARCHAR": "string", "ARRAY_CAT": "concat", "ARRAY_TO_STRING": "array_join", "GREATEST_IGNORE_NULLS": "greatest", "LEAST_IGNORE_NULLS": "least", "HLL": "approx_count_distinct", "SYSDATE": "current_timestamp", "REGEXP_LIKE": "regexp_like", "UUID_STRING": "uuid"},
    "duckdb": {"LIST": "collect_list", "LIST_VALUE": "array", "LIST_CONTAINS": "array_contains", "LIST_SORT": "sort_array", "LIST_DISTINCT": "array_distinct", "LIST_TRANSFORM": "transform", "LIST_FILTER": "filter", "LIST_MAX": "array_max", "LIST_MIN": "array_min", "STRLEN": "octet_length", "ARG_MAX": "max_by", "ARG_MIN": "min_by", "REGEXP_MATCHES": "regexp_like", "QUANTILE_CONT": "percentile", "EPOCH": "unix_timestamp", "STARTS_WITH": "startswith", "ENDS_WITH": "endswith", "UNNEST": "explode", "ARRAY_LENGTH": "size", "LIST_CONCAT": "concat", "LIST_REVERSE": "reverse", "TO_BASE64": "base64", "FROM_BASE64": "unbase64", "APPROX_QUANTILE": "approx_percentile", "PREFIX": "startswith", "SUFFIX": "endswith", "GENERATE_SERIES": "sequence", "FSUM": "sum", "LIST_HAS_ANY": "arrays_overlap", "ORD": "ascii"},
    "bigquery": {"SAFE_DIVIDE": "try_divide", "COUNTIF": "count_if", "ARRAY_LENGTH": "size", "GENERATE_ARRAY": "sequence", "LOGICAL_AND": "bool_and", "LOGICAL_OR": "bool_or", "STARTS_WITH": "startswith", "ENDS_WITH": "endswith", "SAFE_ADD": "try_add", "SAFE_SUBTRACT": "try_subtract", "SAFE_MULTIPLY": "try_multiply", "REGEXP_CONTAINS": "regexp_like", "TO_HEX": "hex", "BYTE_LENGTH": "octet_length", "STRING_AGG": "listagg", "ARRAY_TO_STRING": "array_join", "ARRAY_CONCAT": "concat", "ARRAY_REVERSE": "reverse", "TO_BASE64": "base64", "FROM_BASE64": "unbase64", "GENERATE_UUID": "uuid"},
    "postgres": {"STRPOS": "instr", "EVERY": "bool_and", "CARDINALITY": "size", "CLOCK_TIMESTAMP": "current_timestamp", "ARRAY_AGG": "collect_list", "BTRIM": "trim", "ARRAY_TO_STRING": "array_join", "ARRAY_CAT": "concat", "GEN_RANDOM_UUID": "uuid", "STATEMENT_TIMESTAMP": "current_timestamp"},
    "mysql": {"CURDATE": "current_date", "UCASE": "upper", "LCASE": "lower", "STD": "stddev_pop", "VARIANCE": "var_pop", "STDDEV": "stddev_pop", "LENGTH": "octet_length", "MID": "substring", "JSON_EXTRACT": "get_json_object", "TO_BASE64": "base64", "FROM_BASE64": "unbase64"},
    "redshift": {"NVL": "coalesce", "GETDATE": "current_timestamp", "STRPOS": "instr", "SYSDATE": "current_timestamp", "CHARINDEX": "locate", "BTRIM": "trim", "TEXTLEN": "length", "ISNULL": "coalesce", "BOOL_AND": "bool_and", "BOOL_OR": "bool_or", "LISTAGG": "listagg", "APPROXIMATE_COUNT": "approx_count_distinct"},
    "trino": {"CARDINALITY": "size", "APPROX_DISTINCT": "approx_count_distinct", "ARBITRARY": "any_value", "CONTAINS": "array_contains", "STRPOS": "instr", "CODEPOINT": "ascii", "ARRAY_AGG": "collect_list", "JSON_EXTRACT_SCALAR": "get_json_object", "JSON_EXTRACT": "get_json_object", "LEVENSHTEIN_DISTANCE": "levenshtein", "TO_UTF8": "encode", "REDUCE_AGG": "aggregate", "SET_AGG": "collect_set", "MAP_AGG": "map_from_arrays", "RANDOM": "rand", "BOOL_AND": "bool_and", "BITWISE_AND_AGG": "bit_and", "BITWISE_OR_AGG": "bit_or", "BITWISE_XOR_AGG": "bit_xor", "IS_NAN": "isnan", "SEQUENCE": "sequence", "REDUCE": "aggregate", "ANY_MATCH": "exists", "ALL_MATCH": "forall", "FROM_UNIXTIME": "timestamp_seconds", "URL_EXTRACT_HOST": "parse_url", "MD5": "md5", "TO_UNIXTIME": "unix_timestamp", "COUNT_IF": "count_if", "WEEK": "weekofyear", "DOW": "dayofweek", "DOY": "dayofyear"},
    "sqlite": {"IFNULL": "coalesce", "IIF": "if", "GROUP_CONCAT": "listagg", "JSON_EXTRACT": "get_json_object", "TOTAL": "sum", "UNICODE": "ascii", "RANDOM": "rand", "CHAR": "char", "STRING_AGG": "listagg"},
    "spark": {},
}


WORDS = ("AND", "OR", "NOT", "IN", "ON", "BY", "THEN", "ELSE", "WHEN", "CASE", "OVER", "VALUES", "USING", "EXISTS", "LIKE", "BETWEEN", "IS", "UNION", "EXCEPT", "INTERSECT", "ALL", "DISTINCT", "AS", "JOIN", "END", "ANY", "SOME")
TYPE_WORDS = ("NUMERIC", "DECIMAL", "VARCHAR", "CHAR", "NUMBER")


class Group(list):
    """What stands between parentheses."""


def text(nodes) -> str:
    return " ".join(f"({text(n)})" if isinstance(n, Group) else n for n in nodes)


def _is(node, *words: str) -> bool:
    return isinstance(node, str) and node.upper() in words


def _literal(token: str, dialect: str) -> str:
    quote, body = token[0], token[1:-1]
    if dialect not in BACKSLASH:
        body = body.replace("\\", "\\\\")
    body = body.replace(quote * 2, quote).replace(f"\\{quote}", quote)
    return "'" + body.replace("'", "\\'") + "'"


def _lexer(dialect: str) -> re.Pattern:
    quoted = r"(?:[^{0}\\]|{0}{0}|\\.)*" if dialect in BACKSLASH else "(?:[^{0}]|{0}{0})*"
    e_texts, params = dialect in ("postgres", "duckdb", "redshift"), {"tsql": r"@@?\w+", "mysql": r"@@?\w+", "bigquery": r"@@?\w+", "postgres": r"\$\d+", "duckdb": r"\$\w+", "redshift": r"\$\d+"}.get(dialect)
    kinds = [
        ("skip", r"\s+|--[^\n]*|/\*.*?\*/" + (r"|\#[^\n]*" if dialect == "mysql" else "")),
        ("dollar", r"\$\$.*?\$\$"),
        *([("escaped", r"[Ee]'(?:[^'\\]|\\.|'')*'")] if e_texts else []),
        *([("raw", r"[Rr]'[^']*'|[Rr]\"[^\"]*\"")] if dialect == "bigquery" else []),
        ("hex", r"[Xx]'[0-9A-Fa-f]*'"),
        *([("param", params)] if params else []),
        ("text", "[Nn]?'" + quoted.format("'") + "'" + ('|"' + quoted.format('"') + '"' if dialect in DOUBLE_QUOTED_TEXT else "")),
        ("name", r'"(?:[^"]|"")*"|`[^`]*`' + (r"|\[[^\]]*\]" if dialect == "tsql" else "")),
        ("plain", r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[^\W\d][\w$]*|::|\|>|\|\||&&|==|<=>|<=|>=|<>|!=|->>?|=>|//|!~\*?|~\*|:=|."),
    ]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds), re.DOTALL)


def pieces(sql: str, dialect: str):
    """(kind, text, place) of each token, blank and comment."""
    return ((m.lastgroup, m[0], m.start()) for m in _lexer(resolve_dialect(dialect)).finditer(sql))


def lex(sql: str, dialect: str) -> Group:
    """Tokens, nested; comments go, names come in backticks and texts in single quotes."""
    stack = [Group()]
    for m in _lexer(dialect).finditer(sql):
        token = m[0]
        if m.lastgroup == "text":
            token = _literal(token.lstrip("Nn"), dialect)
        elif m.lastgroup == "escaped":
            token = _literal(token[1:], "spark")
        elif m.lastgroup == "raw":
            token = _literal("'" + token[2:-1].replace("'", "''") + "'", "postgres")
        elif m.lastgroup == "param":
            if token.startswith("@@"):
                raise ValueError(f"{token} has no form in Spark SQL")
            token = ":" + ("p" if token[1].isdigit() else "") + token[1:]
        elif m.lastgroup == "dollar":
            token = _literal("'" + token[2:-2].replace("\\", "\\\\" if dialect in BACKSLASH else "\\").replace("'", "''") + "'", dialect)
        elif m.lastgroup == "name":
            token = "`" + token[1:-1].replace('""', '"').replace("`", "``") + "`"
        if m.lastgroup == "skip":
            continue
        if token == "(":
            stack.append(Group())
        elif token == ")":
            if len(stack) == 1:
                raise ValueError(f"a parenthesis at {m.start()} was not opened")
            group = stack.pop()
            stack[-1].append(group)
        else:
            stack[-1].append(token)
    if len(stack) > 1:
        raise ValueError("a parenthesis is not closed")
    return stack[0]


def split(nodes: list, at: str = ",") -> list[list]:
    out: list[list] = [[]]
    depth = 0  # of square brackets
    for n in nodes:
        depth += _is(n, "[") - _is(n, "]")
        out.append([]) if _is(n, at) and not depth else out[-1].append(n)
    return out


def _arrays(nodes: list) -> list:
    """Array literals, ``[a, b]`` or ``ARRAY[a, b]``, as calls; brackets after a value are subscripts and stay."""
    out, at = [], 0
    while at < len(nodes):
        n, last = nodes[at], out[-1] if out else ""
        value = isinstance(last, Group) or last in ("]",) or isinstance(last, str) and bool(re.fullmatch(r"[\w.`]+|'.*'", last, re.S)) and last.upper() not in (*CLAUSES, "ARRAY", "THEN", "ELSE", "WHEN", "AND", "OR", "NOT", "IN", "ON", "BY", "AS")
        if not _is(n, "[") or value:
            out.append(n)
            at += 1
            continue
        depth, end = 0, at
        while end < len(nodes):
            depth += _is(nodes[end], "[") - _is(nodes[end], "]")
            if not depth:
                break
            end += 1
        out[len(out) - _is(last, "ARRAY") :] = ["array", Group(_arrays(nodes[at + 1 : end]))]
        at = end + 1
    return out


def _operand(out: list) -> int:
    """Where the value that ends ``out`` begins: a name, call, literal or group, with its path, subscripts and casts."""
    i = len(out) - 1
    while i >= 0:
        if isinstance(out[i], Group):
            if i and isinstance(out[i - 1], str) and re.fullmatch(r"[^\W\d]\w*|`.*`", out[i - 1]) and not _is(out[i - 1], *CLAUSES, *WORDS):
                i -= 1
                if _is(out[i], *TYPE_WORDS) and i and out[i - 1] == "::":
                    i -= 2
                    continue
        elif _is(out[i], "]"):
            depth = 0
            while True:
                depth += _is(out[i], "]") - _is(out[i], "[")
                if not depth:
                    break
                i -= 1
            i -= 1
            continue
        if i >= 2 and out[i - 1] == "::":
            i -= 2
            continue
        if i >= 2 and out[i - 1] == ".":
            i -= 2
            continue
        if i >= 1 and _is(out[i], "END"):
            depth = 0
            while i >= 0:
                depth += _is(out[i], "END") - _is(out[i], "CASE")
                if not depth:
                    break
                i -= 1
        return max(i, 0)
    return 0


def _value(nodes: list, at: int) -> int:
    """Where the value that begins at ``at`` ends (after signs)."""
    while at < len(nodes) and _is(nodes[at], "-", "+"):
        at += 1
    if _is(nodes[at], "CASE"):
        depth = 0
        for at in range(at, len(nodes)):
            depth += _is(nodes[at], "CASE") - _is(nodes[at], "END")
            if not depth:
                break
    name, at = nodes[at], at + 1
    while at < len(nodes):
        if isinstance(nodes[at], Group) and isinstance(name, str) and re.fullmatch(r"[^\W\d]\w*|`.*`", name) and not _is(name, *WORDS):
            at += 1
            name = ""
        elif nodes[at] in (".", "::") and at + 1 < len(nodes):
            name, at = nodes[at + 1], at + 2
        elif _is(nodes[at], "["):
            while at < len(nodes) and not _is(nodes[at], "]"):
                at += 1
            at += 1
        else:
            break
    return at


def _kind(nodes: list, types: dict[str, str]) -> str | None:
    """``integral``, ``other``, ``text`` or None (unknown) for an expression."""
    nodes = [n for n in nodes if not _is(n, "-", "+") or len(nodes) > 1]
    if not nodes:
        return None
    if "::" in nodes:
        nodes = [nodes[-2] if isinstance(nodes[-1], Group) else nodes[-1]]
        t = nodes[0].lower() if isinstance(nodes[0], str) else ""
        t = TYPES.get(t.upper(), t).lower()
        return "integral" if t in INTEGRAL else "text" if t in ("string", "varchar") else "other"
    if any(isinstance(n, str) and n in "+-*/%" for n in nodes):
        parts, kinds = [[]], []
        for n in nodes:
            parts.append([]) if isinstance(n, str) and n in "+-*/%" else parts[-1].append(n)
        kinds = [_kind(x, types) for x in parts if x]
        return "text" if "text" in kinds else "other" if "other" in kinds else None if None in kinds else "integral"
    last = nodes[-1]
    if isinstance(last, Group):
        word = nodes[-2].upper() if len(nodes) > 1 and isinstance(nodes[-2], str) else ""
        if not word:
            return _kind(list(last), types) if not any(_is(n, "SELECT") for n in last) else None
        if word in ("CAST", "TRY_CAST"):
            at = max((j for j, x in enumerate(last) if _is(x, "AS")), default=len(last) - 2)
            return _kind(["x", "::", *last[at + 1 :]], types)
        if word in ("SUM", "MIN", "MAX", "ABS", "COALESCE", "NULLIF", "ISNULL", "MOD"):
            return _kind(split(last)[0], types)
        return "integral" if word in INTEGRAL_CALLS else "other" if word in FRACTIONAL_CALLS else "text" if word in TEXT_CALLS else None
    if last.isdigit():
        return "integral"
    if last[:1] == "'":
        return "text"
    if re.fullmatch(r"[\d.]+(?:[eE][+-]?\d+)?", last):
        return "other"
    t = types.get(last.strip("`").lower())
    return None if t is None else "integral" if t in INTEGRAL else "text" if t.startswith(("string", "varchar", "char")) else "other"


def _extremes(nodes: list, types: dict[str, str]) -> list:
    """DuckDB's arg_max and arg_min, which pass over nulls of both arguments.

    Of equal rows DuckDB keeps the first it meets, which has no meaning in a shuffle; here
    the least value counts, so the result is always the same (that of DuckDB on one thread
    if the table is in order of the value).  Where neither argument is known to be an
    integer, arg_max takes the value whose text is least.
    """
    out: list = []
    for n in nodes:
        args = split(n) if isinstance(n, Group) and out and _is(out[-1], "ARG_MAX", "ARGMAX", "MAX_BY", "ARG_MIN", "ARGMIN", "MIN_BY") and (len(out) < 2 or out[-2] != ".") else []
        if len(args) != 2 or not all(args) or _is(args[0][0], "DISTINCT", "ALL") or any(_is(x, "ORDER") for x in n):
            out.append(n)
            continue
        value, key = text(args[0]), text(args[1])
        rank, by = f"{key}, {value}", "min_by"
        if "MAX" in out.pop().upper():
            if _kind(args[0], types) == "integral":
                rank, by = f"{key}, ~({value})", "max_by"
            elif _kind(args[1], types) == "integral":
                rank = f"~({key}), {value}"
            else:  # the hex digits turned round, and an end above all of them, sort texts backwards
                rank, by = f"{key}, translate(hex(CAST({value} AS STRING)), '0123456789ABCDEF', 'FEDCBA9876543210') || 'G'", "max_by"
        out.append(f"{by}({value}, CASE WHEN ({value}) IS NOT NULL AND ({key}) IS NOT NULL THEN struct({rank}) END)")
    return out


def _arithmetic(nodes: list, dialect: str, types: dict[str, str]) -> list:
    """Division of integers, T-SQL's ``+`` of texts, MySQL's ``||`` and JSON arrows in Spark's words."""
    if dialect == "mysql":
        nodes = ["OR" if n == "||" else "AND" if n == "&&" else n for n in nodes]
    nodes = ["=" if n == "==" else n for n in nodes]
    out, at = [], 0
    while at < len(nodes):
        n = nodes[at]
        if n == "/" and dialect in INTEGER_DIVISION and out and at + 1 < len(nodes):
            begin = _operand(out)
            while begin >= 2 and out[begin - 1] in ("*", "%", "/", "DIV"):
                begin = _operand(out[: begin - 1])
            end = _value(nodes, at + 1)
            left, right = out[begin:], _arithmetic(nodes[at + 1 : end], dialect, types)
            kinds = _kind(left, types), _kind(right, types)
            if "other" in kinds or "text" in kinds:
                made = [*left, "/", *right]
            elif kinds == ("integral", "integral"):
                made = ["(", *left, "DIV", *right, ")"]
            else:
                whole = ", ".join(f"'{t}'" for t in ("tinyint", "smallint", "int", "bigint"))
                l, r = text(left), text(right)
                made = [f"(CASE WHEN typeof({l}) IN ({whole}) AND typeof({r}) IN ({whole}) THEN sign(({l}) / ({r})) * floor(abs(({l}) / ({r}))) ELSE ({l}) / ({r}) END)"]
            out[begin:] = [Group(made[1:-1])] if made[0] == "(" else made
            at = end
        elif n in ("->", "->>") and dialect in ("mysql", "postgres", "sqlite", "duckdb", "redshift") and out and at + 1 < len(nodes) and isinstance(nodes[at + 1], str) and (nodes[at + 1][0] == "'" or nodes[at + 1].isdigit()):
            begin, key = _operand(out), nodes[at + 1]
            path = key if key.startswith("'$") else f"'$[{key}]'" if key.isdigit() else "'$." + key[1:]
            out[begin:] = ["get_json_object", Group([*out[begin:], ",", path])]
            at += 2
        else:
            out.append(n)
            at += 1
    if dialect == "tsql" and "+" in out:
        # a chain of additions joins texts if one of its terms is a text
        marks = [-1, *(i for i, n in enumerate(out) if isinstance(n, str) and (n in (",", "=", "<", ">", "<=", ">=", "<>", "!=") or _is(n, *CLAUSES, *WORDS, "AS"))), len(out)]
        for a, b in zip(marks, marks[1:]):
            terms = [[]]
            for n in out[a + 1 : b]:
                terms.append([]) if n == "+" else terms[-1].append(n)
            if len(terms) > 1 and any(_kind(t, types) == "text" for t in terms if t):
                for i in range(a + 1, b):
                    out[i] = "||" if out[i] == "+" else out[i]
    return out


def _subscripts(nodes: list, dialect: str) -> list:
    """Subscripts and slices, counted as the dialect counts, as calls."""
    out, at = [], 0
    while at < len(nodes):
        if not _is(nodes[at], "[") or not out:
            out.append(nodes[at])
            at += 1
            continue
        depth, end = 0, at
        while end < len(nodes):
            depth += _is(nodes[end], "[") - _is(nodes[end], "]")
            if not depth:
                break
            end += 1
        inner = _subscripts(nodes[at + 1 : end], dialect)
        begin, at = _operand(out), end + 1
        of, parts = out[begin:], split(inner, ":")
        if len(parts) > 1:
            if dialect not in ("duckdb", "postgres") or len(parts) > 2 or any(_is(n, "-") for x in parts for n in x[:1]):
                raise ValueError("this slice has no form in Spark SQL: use functions.text.list_slice")
            low, high = text(parts[0]) or "1", text(parts[1]) or f"size({text(of)})"
            out[begin:] = [f"slice({text(of)}, {low}, greatest({high} - {low} + 1, 0))"]
        elif len(inner) == 1 and isinstance(inner[0], str) and inner[0][0] == "'":
            out += ["[", *inner, "]"]
        elif dialect == "bigquery":
            word = inner[0].upper() if isinstance(inner[0], str) else ""
            call = {"OFFSET": "get", "SAFE_OFFSET": "get", "ORDINAL": "element_at", "SAFE_ORDINAL": "try_element_at"}.get(word)
            out[begin:] = [call or "get", Group([*of, ",", *(inner[1] if call else inner)])]
        elif dialect == "duckdb":
            place = text(inner)
            out[begin:] = ["try_element_at", Group([*of, ",", place if re.fullmatch(r"-? ?[1-9]\d*", place) else f"nullif({place}, 0)"])]
        elif dialect in ("postgres", "redshift"):
            out[begin:] = ["get", Group([*of, ",", f"({text(inner)}) - 1" if dialect == "postgres" else text(inner)])]
        elif dialect == "trino":
            out[begin:] = ["element_at", Group([*of, ",", *inner])]
        elif dialect == "snowflake":
            out[begin:] = ["get", Group([*of, ",", *inner])]
        else:
            out += ["[", *inner, "]"]
    return out


def _bare(literal: str) -> str | None:
    """The text of a literal token, None if it is none."""
    if not re.fullmatch(r"'(?:[^'\\]|\\.)*'", literal, re.S):
        return None
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), literal[1:-1])


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _regexp_replace(args: list[str], dialect: str) -> list:
    """All matches, or without the flag g only the first; ``\\1`` becomes ``$1``."""
    pattern, new = _bare(args[1]), _bare(args[2]) if len(args) > 2 else ""
    flags = _bare(args[3]) if len(args) > 3 else ""
    if pattern is None or new is None or flags is None:
        raise ValueError("REGEXP_REPLACE needs its pattern and replacement as literals")
    first = dialect in ("duckdb", "postgres") and "g" not in flags
    if dialect not in ("mysql", "trino"):
        new = re.sub(r"\\(\d)", lambda m: f"\0{m[1]}", new).replace("\\&", "\x000").replace("\\\\", "\\").replace("\\", "\\\\").replace("$", "\\$").replace("\0", "$")
    if first:
        new = "$1" + re.sub(r"(?<!\\)\$(\d)", lambda m: "${x}" if m[1] == "0" else f"${int(m[1]) + 1}", new).replace("${x}", "$2")
        inner = f"({pattern})" if "$2" in new and "(" not in pattern else f"(?:{pattern})"
        pattern = f"^((?s:.*?)){inner}"
    if "i" in flags:
        pattern = "(?i)" + pattern
    return [f"regexp_replace({args[0]}, {_quoted(pattern)}, {_quoted(new)})"]


def _regexp_extract(args: list[str], dialect: str) -> list:
    group = args[2] if len(args) > 2 else "0"
    if dialect == "bigquery":
        pattern = _bare(args[1])
        if pattern is None:
            raise ValueError("REGEXP_EXTRACT needs its pattern as a literal")
        group = "1" if re.compile(pattern).groups else "0"
    call = f"regexp_extract({args[0]}, {args[1]}, {group})"
    return [call] if dialect == "duckdb" else [f"CASE WHEN ({args[0]}) RLIKE {args[1]} THEN {call} END"]


#: (dialect, function): whether it reads (to a date or timestamp) or writes text, and where value and format stand.
FORMATTED = {
    ("duckdb", "STRFTIME"): ("write", 0, 1), ("duckdb", "STRPTIME"): ("read", 0, 1), ("mysql", "DATE_FORMAT"): ("write", 0, 1), ("mysql", "STR_TO_DATE"): ("read", 0, 1), ("sqlite", "STRFTIME"): ("write", 1, 0),
    ("trino", "DATE_FORMAT"): ("write", 0, 1), ("trino", "DATE_PARSE"): ("read", 0, 1), ("bigquery", "FORMAT_DATE"): ("write", 1, 0), ("bigquery", "FORMAT_TIMESTAMP"): ("write", 1, 0), ("bigquery", "FORMAT_DATETIME"): ("write", 1, 0),
    ("bigquery", "PARSE_DATE"): ("read date", 1, 0), ("bigquery", "PARSE_TIMESTAMP"): ("read", 1, 0), ("bigquery", "PARSE_DATETIME"): ("read", 1, 0),
}


def _formatted(name: str, args: list[str], dialect: str) -> list | None:
    if (dialect, name) in FORMATTED and len(args) > 1:
        kind, value, place = FORMATTED[dialect, name]
        fmt = _bare(args[place])
        if fmt is None:
            raise ValueError(f"{name} needs its format as a literal")
        pattern, of = _quoted(formats.percent(fmt, dialect)), args[value]
        of = f"CAST({of} AS TIMESTAMP)" if dialect == "sqlite" else of
        return [f"date_format({of}, {pattern})" if kind == "write" else f"to_date({of}, {pattern})" if kind == "read date" else f"to_timestamp({of}, {pattern})"]
    if dialect in ("postgres", "redshift", "snowflake") and name in ("TO_CHAR", "TO_VARCHAR", "TO_DATE", "TO_TIMESTAMP") and len(args) == 2:
        fmt = _bare(args[1])
        if fmt is None:
            raise ValueError(f"{name} needs its format as a literal")
        if name in ("TO_CHAR", "TO_VARCHAR") and re.search("[09]", fmt):
            return None  # numbers: Spark reads the same codes
        call = {"TO_DATE": "to_date", "TO_TIMESTAMP": "to_timestamp"}.get(name, "date_format")
        return [f"{call}({args[0]}, {_quoted(formats.template(fmt))})"]
    if dialect == "tsql" and name == "FORMAT" and len(args) > 1 and (fmt := _bare(args[1])):
        return [f"date_format({args[0]}, {_quoted(fmt.replace('tt', 'a').replace('fff', 'SSS').replace('dddd', 'EEEE').replace('ddd', 'EEE'))})"]
    return None


def boundary_diff(unit: str, first: str, last: str, dialect: str) -> str:
    """How many starts of ``unit`` lie after ``first`` up to ``last``."""
    unit = unit.strip("'` ").upper()
    shift = " + INTERVAL '1' DAY" if dialect == "tsql" and unit == "WEEK" else ""  # its weeks start on Sunday
    return f"timestampdiff({unit}, date_trunc('{unit}', ({first}){shift}), date_trunc('{unit}', ({last}){shift}))"


def _call(name: str, group: Group, dialect: str) -> list | None:
    """A function's call in Spark's words, or None if it stays."""
    args = [text(a) for a in split(group)]
    if name in ("DATEDIFF", "DATE_DIFF", "TIMESTAMPDIFF") and len(args) == 3 and dialect != "trino":
        unit, first, last = (args[2], args[1], args[0]) if dialect == "bigquery" else args
        return None if dialect in ("spark", "mysql") else [boundary_diff(unit, first, last, dialect)]
    if dialect == "tsql" and name == "DATEPART":
        return [f"extract({args[0]} FROM {args[1]})"]
    if (made := _formatted(name, args, dialect)) is not None:
        return made
    if dialect == "tsql" and name in ("CONVERT", "TRY_CONVERT"):
        kind, cast = text(_typed(split(group)[0])), "try_cast" if name == "TRY_CONVERT" else "CAST"
        if len(args) < 3:
            return [f"{cast}({args[1]} AS {kind})"]
        pattern = formats.STYLES.get(int(args[2])) if args[2].isdigit() else None
        if pattern is None:
            raise ValueError(f"CONVERT with style {args[2]} has no form in Spark SQL")
        if kind == "STRING":
            of, length = f"date_format({args[1]}, {_quoted(pattern)})", split(group)[0][1:]
            return [f"left({of}, {text(length[0])})" if length and text(length[0]).isdigit() else of]
        return [f"CAST({'try_' if cast == 'try_cast' else ''}to_timestamp({args[1]}, {_quoted(pattern)}) AS {kind})"]
    if name == "REGEXP_REPLACE" and dialect in ("duckdb", "postgres", "redshift", "snowflake", "bigquery") and len(args) in (2, 3, 4):
        return _regexp_replace(args, dialect)
    if name == "REGEXP_EXTRACT" and dialect in ("duckdb", "bigquery", "trino"):
        return _regexp_extract(args, dialect)
    if dialect == "tsql" and name == "LEN":
        return [f"length(rtrim({args[0]}))"]
    if dialect in ("tsql", "snowflake", "redshift") and name in ("DATEADD", "TIMESTAMPADD") and len(args) == 3:
        return [f"timestampadd({args[0].strip(chr(39) + ' ').upper()}, {args[1]}, {args[2]})"]
    if dialect == "trino" and name == "DATE_ADD" and len(args) == 3:
        return [f"timestampadd({args[0].strip(chr(39))}, {args[1]}, {args[2]})"]
    if dialect == "trino" and name == "DATE_DIFF" and len(args) == 3:
        return [f"timestampdiff({args[0].strip(chr(39))}, {args[1]}, {args[2]})"]
    if dialect == "trino" and name == "FORMAT_DATETIME":
        return ["date_format", group]
    if dialect in ("trino", "duckdb") and name == "TRY" and len(args) == 1:
        raise ValueError("TRY around an expression has no form in Spark SQL: use the try_ functions")
    if dialect == "redshift" and name == "LEN":
        return ["length", group]
    if dialect == "redshift" and name == "CONVERT" and len(args) == 2:
        return [f"CAST({args[1]} AS {text(_typed(split(group)[0]))})"]
    if dialect == "duckdb" and name in ("TIME_BUCKET",) and len(args) == 2:
        width = re.sub(r"^INTERVAL\s*\(?|\)$", "", args[0], flags=re.I).replace("'", "").strip(" ()")
        return [f"window({args[1]}, '{width}').start"]
    if dialect == "sqlite" and name == "DATE" and len(args) == 1:
        return ["to_date", group]
    if dialect == "snowflake" and name in ("DIV0", "DIV0NULL"):
        zero = f"({args[1]}) = 0" + (f" OR ({args[1]}) IS NULL" if name == "DIV0NULL" else "")
        return [f"CASE WHEN {zero} THEN 0 ELSE ({args[0]}) / ({args[1]}) END"]
    if name == "CONCAT" and dialect in SKIPS_NULLS:
        return [f"concat_ws('', {', '.join(args)})"]
    if name in ("GREATEST", "LEAST") and dialect in NULL_IF_ANY:
        return [f"CASE WHEN {' AND '.join(f'({a}) IS NOT NULL' for a in args)} THEN {name.lower()}({', '.join(args)}) END"]
    if name == "LOG" and dialect in ("tsql", "bigquery") and len(args) == 2:
        return [f"log({args[1]}, {args[0]})"]
    if name == "LOG" and dialect in ("duckdb", "postgres", "redshift", "sqlite") and len(args) == 1:
        return [f"log10({args[0]})"]
    if name == "TRUNC" and dialect in ("duckdb", "postgres", "bigquery") and len(args) == 1:
        return [f"(sign({args[0]}) * floor(abs({args[0]})))"]
    if dialect == "duckdb" and name == "DAYOFWEEK":
        return [f"(dayofweek({args[0]}) - 1)"]
    if dialect == "duckdb" and name in ("ARRAY_SLICE", "LIST_SLICE") and len(args) == 3:
        return [f"slice({args[0]}, {args[1]}, greatest(({args[2]}) - ({args[1]}) + 1, 0))"]
    if dialect == "snowflake" and name == "ARRAY_CONTAINS":
        return [f"array_contains({args[1]}, {args[0]})"]
    if dialect == "postgres" and name == "ARRAY_LENGTH":
        return [f"nullif(size({args[0]}), 0)"]
    if dialect == "tsql" and name == "STUFF":
        return [f"overlay({args[0]} PLACING {args[3]} FROM {args[1]} FOR {args[2]})"]
    if dialect == "bigquery" and name == "DIV":
        return [f"(({args[0]}) div ({args[1]}))"]
    if dialect == "bigquery" and name.rpartition("_")[2] in ("ADD", "SUB") and name.rpartition("_")[0] in ("DATE", "DATETIME", "TIMESTAMP"):
        return [f"(({args[0]}) {'+' if name.endswith('ADD') else '-'} {args[1]})"]
    if (dialect, name) in LITERAL_SPLITS:
        return [f"split({args[0]}, concat('\\\\Q', {args[1]}, '\\\\E'))"]
    if dialect == "bigquery" and name in ("TIMESTAMP_TRUNC", "DATE_TRUNC", "DATETIME_TRUNC") and len(args) > 1:
        return [f"date_trunc('{args[1]}', {args[0]})"]
    if dialect == "bigquery" and name == "SAFE_CAST":
        return ["try_cast", group]
    if dialect == "mysql" and name in ("DATE_ADD", "DATE_SUB") and args[1].upper().startswith("INTERVAL"):
        return [f"(({args[0]}) {'+' if name == 'DATE_ADD' else '-'} {args[1]})"]
    if dialect == "mysql" and name == "GROUP_CONCAT":
        body, comma = split(group, "SEPARATOR"), "','"
        order = next((i for i, n in enumerate(body[0]) if _is(n, "ORDER")), len(body[0]))
        within = f" WITHIN GROUP ({text(body[0][order:])})" if order < len(body[0]) else ""
        return [f"listagg({text(body[0][:order])}, {text(body[1]) if len(body) > 1 else comma}){within}"]
    if name in ("STRING_AGG", "ARRAY_AGG", "LIST") and any(_is(n, "ORDER") for n in group) and name != "STRING_AGG" and dialect != "spark":
        order = next(i for i, n in enumerate(group) if _is(n, "ORDER"))
        keys, value = split(group[order + 2 :]), text(group[:order])
        if len(keys) != 1 or text([n for n in keys[0] if not _is(n, "ASC", "DESC", "NULLS", "FIRST", "LAST")]) != value:
            raise ValueError(f"{name} in another order than that of its values has no form in Spark SQL: use sort_array over structs")
        return [f"sort_array(collect_list({value}), {'false' if any(_is(n, 'DESC') for n in keys[0]) else 'true'})"]
    if dialect in ("duckdb", "postgres", "bigquery", "sqlite") and name in ("STRING_AGG", "GROUP_CONCAT") and any(_is(n, "ORDER") for n in group):
        order = next(i for i, n in enumerate(group) if _is(n, "ORDER"))
        return [f"listagg({text(group[:order])}) WITHIN GROUP ({text(group[order:])})"]
    return [NAMES[dialect][name], group] if name in NAMES[dialect] else None


def _typed(nodes: list) -> list:
    """A type in Spark's words: [name] or [name, (lengths)]."""
    name = nodes[0].upper() if nodes and isinstance(nodes[0], str) else ""
    if name in ("NUMERIC", "NUMBER") and len(nodes) > 1 and isinstance(nodes[1], Group):
        return ["DECIMAL", *nodes[1:]]
    if name in TYPES:
        return [TYPES[name], *(nodes[2:] if len(nodes) > 1 and isinstance(nodes[1], Group) else nodes[1:])]
    return nodes


def _ordered(nodes: list, dialect: str) -> list:
    """Null ordering spelled out in every ORDER BY of this level."""
    if dialect not in NULLS_LAST | NULLS_HIGH:
        return nodes
    out, i = [], 0
    while i < len(nodes):
        out.append(nodes[i])
        i += 1
        if not (_is(out[-1], "ORDER") and i < len(nodes) and _is(nodes[i], "BY")):
            continue
        end = next((j for j in range(i, len(nodes)) if _is(nodes[j], *ORDER_ENDS)), len(nodes))
        keys = split(nodes[i + 1 : end])
        out.append("BY")
        for k, key in enumerate(keys):
            if not any(_is(n, "NULLS") for n in key) and not _is(key[0], "ALL"):
                last = dialect in NULLS_LAST or not _is(key[-1], "DESC")
                key = [*key, "NULLS", "LAST" if last else "FIRST"]
            out += [*([","] if k else []), *key]
        i = end
    return out


READERS = {"READ_PARQUET": "parquet", "PARQUET_SCAN": "parquet", "READ_CSV": "csv", "READ_CSV_AUTO": "csv", "READ_JSON": "json", "READ_JSON_AUTO": "json"}
HINTS = {"NOLOCK", "READPAST", "ROWLOCK", "UPDLOCK", "HOLDLOCK", "TABLOCK", "READUNCOMMITTED", "READCOMMITTED", "SERIALIZABLE", "NOEXPAND", "INDEX"}


def _json_rows(source: str, path: str | None, columns: list[list], dialect: str) -> str:
    """Typed rows of the objects of a JSON array (or of one object) at a path."""
    place = (_bare(path) if path else "$").replace("lax ", "").replace("strict ", "").removesuffix("[*]") or "$"
    at = source if place == "$" else f"get_json_object({source}, {_quoted(place)})"
    fields = []
    for c in columns:
        name = text(c[:1])
        if any(_is(n, "NESTED") for n in c[:1]):
            raise ValueError("NESTED PATH has no form in Spark SQL: use operators.shape.json_table")
        if any(_is(n, "ORDINALITY") for n in c):
            fields.append((name, "__i + 1"))
            continue
        where = next((_bare(n) for n in c[1:] if isinstance(n, str) and n[0] == "'"), "$." + name.strip("`"))
        kind = [n for n in c[1 : next((i for i, n in enumerate(c) if _is(n, "PATH", "AS", "NULL", "DEFAULT", "ERROR") or isinstance(n, str) and n[0] == "'"), len(c))]]
        fields.append((name, f"try_cast(get_json_object(__x, {_quoted(where.removeprefix('lax ').removeprefix('strict '))}) AS {text(_typed(kind))})"))
    made = ", ".join(f"{_quoted(n.strip('`'))}, {e}" for n, e in fields)
    return f"inline(transform(from_json(if(startswith(ltrim({at}), '['), {at}, concat('[', {at}, ']')), 'array<string>'), (__x, __i) -> named_struct({made})))"


def _table_function(word: str, group: Group, rest: list, dialect: str, lateral: bool) -> tuple[list, int] | None:
    """(tokens, how many of ``rest`` they use) for a function in FROM, or None."""
    args = split(group)
    if word == "TABLE" and len(group) == 2 and isinstance(group[1], Group):
        word, args, group = group[0].upper(), split(group[1]), group[1]
    used, ordinal, names, alias, typed = 0, None, [], "", []
    if word == "OPENJSON" and rest and _is(rest[0], "WITH") and len(rest) > 1 and isinstance(rest[1], Group):
        typed, used = split(rest[1]), 2
    elif word == "JSON_TABLE" and any(_is(n, "COLUMNS") for n in group):
        typed = split(next(n for i, n in enumerate(group) if i and _is(group[i - 1], "COLUMNS")))

    def marked() -> None:
        nonlocal used, ordinal
        if used + 1 < len(rest) and _is(rest[used], "WITH") and _is(rest[used + 1], "ORDINALITY", "OFFSET"):
            ordinal, used = rest[used + 1].upper(), used + 2
            if ordinal == "OFFSET":
                used += used < len(rest) and _is(rest[used], "AS")
                if used < len(rest) and isinstance(rest[used], str) and re.fullmatch(r"`.*`|[^\W\d]\w*", rest[used]) and not _is(rest[used], *CLAUSES, *WORDS, "CROSS", "LEFT", "INNER"):
                    names.append(rest[used])
                    used += 1
                else:
                    names.append("offset")

    marked()
    if used < len(rest) and (_is(rest[used], "AS") or isinstance(rest[used], str) and re.fullmatch(r"`.*`|[^\W\d]\w*", rest[used]) and not _is(rest[used], *CLAUSES, *WORDS, "CROSS", "LEFT", "INNER", "RIGHT", "FULL", "WITH")):
        used += _is(rest[used], "AS")
        alias, used = rest[used], used + 1
        columns = [text(c) for c in split(rest[used])] if used < len(rest) and isinstance(rest[used], Group) else []
        used += bool(columns)
    else:
        columns = []
    marked()
    if word in ("UNNEST", "EXPLODE") and dialect != "spark":
        value = columns[: len(args)] or [alias if alias and dialect != "duckdb" else "unnest" if dialect == "duckdb" else alias or "col"]
        source = text(args[0]) if len(args) == 1 else f"arrays_zip({', '.join(text(a) for a in args)})"
        if ordinal:
            place = names[0] if names else columns[len(args)] if len(columns) > len(args) else "ordinality"
            field = place.strip("`")
            made = f"inline(transform({source}, (__x, __i) -> named_struct('v', __x, '{field}', __i + {int(ordinal == 'ORDINALITY')})))"
            value = [*value, place]
        else:
            made = f"explode({source})" if len(args) == 1 else f"inline({source})"
    elif word in ("GENERATE_SERIES", "RANGE") and dialect != "spark":
        series = [text(a) for a in args]
        if word == "RANGE":
            series = ["0", *series] if len(series) == 1 else series
            step = series[2] if len(series) > 2 else "1"
            made = f"explode(filter(sequence({series[0]}, {series[1]}, {step}), __x -> __x <> {series[1]}))"
        else:
            made = f"explode(sequence({', '.join(series)}))"
        value = columns or [alias if alias and dialect != "duckdb" else word.lower()]
    elif word in ("OPENJSON", "JSON_TABLE"):
        if not typed:
            raise ValueError(f"{word} without columns has no form in Spark SQL: use operators.shape.json_pairs")
        path = text(args[1][:1]) if len(args) > 1 else None
        made, value = _json_rows(text(args[0]), path, typed, dialect), [text(c[:1]) for c in typed]
    elif word == "FLATTEN":
        named = {text(a[:1]).upper(): a[2:] for a in args if len(a) > 2 and a[1] == "=>"}
        if {"RECURSIVE", "PATH", "MODE"} & set(named):
            raise ValueError("FLATTEN with PATH, RECURSIVE or MODE has no form in Spark SQL: use operators.shape.flatten")
        outer = "_outer" if _is((named.get("OUTER") or [""])[0], "TRUE") else ""
        made, value = f"inline{outer}(transform({text(named.get('INPUT', args[0]))}, (__x, __i) -> named_struct('index', __i, 'value', __x)))", ["index", "value"]
    elif word == "SPLIT_TO_TABLE":
        parts = f"split({text(args[0])}, concat('\\\\Q', {text(args[1])}, '\\\\E'))"
        made, value = f"inline(transform({parts}, (__x, __i) -> named_struct('index', __i + 1, 'value', __x)))", ["index", "value"]
    else:
        return None
    return [*(["LATERAL"] if lateral else []), made, "AS", alias or "__f", f"({', '.join(value)})"], used


def _expressions(nodes: list, dialect: str) -> list:
    out: list = []
    i, clause, tables = 0, "", set()
    while i < len(nodes):
        n, after = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None
        i += 1
        word = n.upper() if isinstance(n, str) else ""
        before = out[-1] if out else ""
        if word in CLAUSES and not (word in ("GROUP", "ORDER") and not _is(after, "BY")) and not isinstance(after, Group) or word in ("FROM", "WHERE", "SELECT"):
            clause = word if not (word == "FROM" and _is(before, "DISTINCT")) else clause
        if word in REFUSED.get(dialect, {}) and REFUSED[dialect][word][0](before, after):
            raise ValueError(f"{word} has no form in Spark SQL: use {REFUSED[dialect][word][1]}")
        starts = clause == "FROM" and word not in CLAUSES and (before == "," or _is(before, "FROM", "JOIN"))
        if starts and dialect in ("bigquery", "redshift") and after == "." and word in tables and not _is(before, "FROM"):
            end = _value(nodes, i - 1)  # a path into a table named before: its elements are rows
            at = end + _is(nodes[end] if end < len(nodes) else "", "AS")
            alias = nodes[at] if at < len(nodes) and isinstance(nodes[at], str) and re.fullmatch(r"`.*`|[^\W\d]\w*", nodes[at]) and not _is(nodes[at], *CLAUSES, *WORDS, "CROSS", "LEFT", "INNER", "AT") else ""
            at += bool(alias)
            alias = alias or nodes[end - 1]
            path = text(nodes[i - 1 : end])
            if at + 1 < len(nodes) and _is(nodes[at], "AT"):
                out += ["LATERAL", f"inline(transform({path}, (__x, __i) -> named_struct('v', __x, 'i', __i))) AS {alias} ({alias}, {nodes[at + 1]})"]
                at += 2
            else:
                out += ["LATERAL", f"explode({path}) AS {alias} ({alias})"]
            i = at
            continue
        if starts and dialect == "redshift" and word == "UNPIVOT":
            end = _value(nodes, i)
            if end + 3 < len(nodes) + 1 and _is(nodes[end], "AS") and _is(nodes[end + 2], "AT"):
                out += ["LATERAL", f"explode({text(nodes[i:end])}) AS __f ({nodes[end + 3]}, {nodes[end + 1]})"]
                i = end + 4
                continue
        if starts:
            tables.add(word)
            rest = nodes[i:]
            named = rest[1] if rest and _is(rest[0], "AS") and len(rest) > 1 else rest[0] if rest and isinstance(rest[0], str) else ""
            if isinstance(named, str) and re.fullmatch(r"`.*`|[^\W\d]\w*", named) and not _is(named, *CLAUSES, *WORDS):
                tables.add(named.upper())
        if clause == "FROM" and isinstance(after, Group) and (before in (",", "") or _is(before, "FROM", "JOIN", "LATERAL", "APPLY")):
            made = _table_function(word, after, nodes[i + 1 :], dialect, not _is(before, "FROM", "LATERAL"))
            if made is not None:
                out += made[0]
                i += 1 + made[1]
                continue
        if clause == "FROM" and _is(before, "FROM", "JOIN", ",") and dialect == "duckdb":
            path = _bare(n) if isinstance(n, str) and n[0] == "'" else _bare(text(after)) if word in READERS and isinstance(after, Group) else None
            if path is not None:
                kind = READERS.get(word) or path.rpartition(".")[2].replace("ndjson", "json").replace("jsonl", "json")
                out += [kind, ".", "`" + path.replace("`", "``") + "`"]
                i += word in READERS
                continue
        if dialect == "tsql" and word == "WITH" and isinstance(after, Group) and after and isinstance(after[0], str) and after[0].upper() in HINTS:
            i += 1
            continue
        if dialect == "mysql" and word == "STRAIGHT_JOIN":
            if clause != "SELECT":
                out.append("JOIN")
            continue
        if word == "SIMILAR" and _is(after, "TO") or word == "GLOB" and dialect in ("duckdb", "sqlite"):
            at = i + (word == "SIMILAR")
            pattern = _bare(nodes[at]) if at < len(nodes) and isinstance(nodes[at], str) else None
            if pattern is None:
                raise ValueError(f"{word} needs its pattern as a literal: use functions.text")
            out += ["RLIKE", _quoted(similar_pattern(pattern) if word == "SIMILAR" else glob_pattern(pattern))]
            i = at + 1
            continue
        if word in ELSEWHERE and (word != "GROUPS" or _is(after, "BETWEEN", "UNBOUNDED", "CURRENT")) and (word not in ("ASOF", "POSITIONAL") or _is(after, "JOIN", "LEFT")):
            raise ValueError(f"{word} has no form in Spark SQL: use {ELSEWHERE[word]}")
        if word == "BY" and _is(after, "NAME"):
            raise ValueError("BY NAME has no form in Spark SQL: use operators.shape.union_by_name")
        if word == "EXCLUDE" and _is(after, "CURRENT", "GROUP", "TIES"):
            raise ValueError("EXCLUDE in a frame has no form in Spark SQL: use operators.shape.sum_excluding_current")
        if word in ("CAST", "TRY_CAST", "SAFE_CAST") and isinstance(after, Group):
            at = max((j for j, x in enumerate(after) if _is(x, "AS")), default=None)
            if at is not None:
                after[at + 1 :] = _typed(after[at + 1 :])
        if word and isinstance(after, Group) and not (out and out[-1] == ".") and (made := _call(word, after, dialect)) is not None:
            out += made
            i += 1
        elif word == "::" and after is not None:
            of = [after, nodes[i + 1]] if i + 1 < len(nodes) and isinstance(nodes[i + 1], Group) else [after]
            out += ["::", *_typed(of)]
            i += len(of)
        elif word == "EXCLUDE" or (word == "EXCEPT" and out and out[-1] == "*" and isinstance(after, Group)):
            out += ["EXCEPT", after if isinstance(after, Group) else Group([after])]
            i += 1
        elif word == "REPLACE" and out and isinstance(after, Group) and (out[-1] == "*" or _is(out[-2] if len(out) > 1 else None, "EXCEPT")):
            names = [a[-1] for a in split(after)]
            hidden = [x for name in names for x in (name, ",")][:-1]
            if out[-1] == "*":
                out += ["EXCEPT", Group(hidden), ",", *after]
            else:
                out[-1] += [",", *hidden]
                out += [",", *after]
            i += 1
        elif word == "//" and dialect == "duckdb":
            out.append("DIV")
        elif word in ("~", "!~") and dialect == "postgres" and out:
            out += (["NOT"] if word == "!~" else []) + ["RLIKE"]
        elif word in ("~*", "!~*") and dialect == "postgres" and out:
            out += (["NOT"] if word == "!~*" else []) + ["RLIKE", "'(?i)' ||"]
        elif word in ("CROSS", "OUTER") and _is(after, "APPLY") and i + 2 < len(nodes) and isinstance(nodes[i + 1], str) and isinstance(nodes[i + 2], Group) and (made := _table_function(nodes[i + 1].upper(), nodes[i + 2], nodes[i + 3 :], dialect, False)):
            out += ["CROSS JOIN LATERAL" if word == "CROSS" else "LEFT JOIN LATERAL", *made[0], *([] if word == "CROSS" else ["ON", "true"])]
            i += 3 + made[1]
        elif word in ("CROSS", "OUTER") and _is(after, "APPLY"):
            named = [nodes[i + 1]]
            i += 2
            while i < len(nodes) and len(named) < 3 and isinstance(nodes[i], str) and (_is(nodes[i], "AS") or re.fullmatch(r"`.*`|[^\W\d]\w*", nodes[i])) and not _is(nodes[i], *CLAUSES, "CROSS", "OUTER", "LEFT", "JOIN", "INNER", "ON"):
                named.append(nodes[i])
                i += 1
            out += ["CROSS JOIN LATERAL" if word == "CROSS" else "LEFT JOIN LATERAL", *named, *([] if word == "CROSS" else ["ON", "true"])]
        else:
            out.append(n)
    return out


def _core(nodes: list) -> list:
    """One SELECT with its limits, QUALIFY and DISTINCT ON in Spark's words."""
    marks = [j for j, n in enumerate(nodes) if _is(n, *CLAUSES) and not (_is(n, "FROM") and j and _is(nodes[j - 1], "DISTINCT")) and not (_is(n, "GROUP", "ORDER") and not _is(nodes[j + 1] if j + 1 < len(nodes) else None, "BY"))]
    parts = {nodes[a].upper(): list(nodes[a + 1 : b]) for a, b in zip(marks, [*marks[1:], len(nodes)])}
    if "SELECT" not in parts:
        return ["SELECT", "*", *nodes] if marks and _is(nodes[0], "FROM") else nodes
    items, order = parts["SELECT"], parts.get("ORDER", [])[1:]
    tests: list[str] = [text(parts["QUALIFY"])] if "QUALIFY" in parts else []
    limit, offset, distinct = parts.get("LIMIT"), parts.get("OFFSET"), False
    if limit and "," in limit:
        offset, limit = split(limit)
    ties = False
    if "FETCH" in parts:
        fetch = parts["FETCH"]
        limit, ties = [fetch[1]] if not _is(fetch[1], "ROW", "ROWS") else ["1"], _is(fetch[-1], "TIES")
    if offset:
        offset = [n for n in offset if not _is(n, "ROW", "ROWS")]
    if items and _is(items[0], "DISTINCT", "ALL"):
        distinct, items = _is(items[0], "DISTINCT"), items[1:]
    if distinct and _is(items[0], "ON"):
        keys, items, distinct = text(items[1]), items[2:], False
        tests.append(f"row_number() OVER (PARTITION BY {keys} ORDER BY {text(order) or keys}) = 1")
    if items and _is(items[0], "TOP"):
        limit, items = [items[1]], items[2:]
        if items and _is(items[0], "PERCENT"):
            raise ValueError("TOP PERCENT has no form in Spark SQL: use operators.shape.top_percent")
        if len(items) > 1 and _is(items[0], "WITH") and _is(items[1], "TIES"):
            ties, items = True, items[2:]
    if ties:
        if offset:
            raise ValueError("OFFSET with WITH TIES: use operators.shape.top_with_ties")
        if not order:
            raise ValueError("WITH TIES needs ORDER BY")
    middle = [x for c in ("FROM", "WHERE", "GROUP", "HAVING", "WINDOW") if c in parts for x in (c, *parts[c])]
    tail = [x for c, p in (("LIMIT", limit), ("OFFSET", offset)) if p for x in (c, *p)]
    head = ["SELECT", *(["DISTINCT"] if distinct else [])]
    if ties:
        keys, sorts = [], []
        for k, key in enumerate(split(order)):
            end = next((j for j, n in enumerate(key) if _is(n, "ASC", "DESC", "NULLS")), len(key))
            keys.append((f"`__key{k}`", text(key[:end])))
            sorts.append(f"`__key{k}` {text(key[end:])}")
        names = ", ".join(k for k, _ in keys)
        inner = text(["SELECT", *items, *(f", {e} AS {k}" for k, e in keys), *middle])
        if tests:
            raise ValueError("WITH TIES beside QUALIFY or DISTINCT ON: use operators.shape.top_with_ties")
        matched = " AND ".join(f"`__rows`.{k} <=> `__last`.{k}" for k, _ in keys)
        last = f"(SELECT {names} FROM `__rows` ORDER BY {', '.join(sorts)} LIMIT {text(limit)}) `__last`"
        whole = f"(WITH `__rows` AS ({inner}) SELECT `__rows`.* FROM `__rows` LEFT SEMI JOIN {last} ON {matched})"
        return [*head, f"* EXCEPT ({names})", "FROM", whole, "ORDER BY", ", ".join(sorts)]
    if not tests:
        return [*head, *items, *middle, *(["ORDER BY", *order] if order else []), *tail]
    hidden, sort = ["`__kept`"], []
    extra = [",", "(" + " AND ".join(f"({t})" for t in tests) + ") AS `__kept`"]
    for key in split(order) if order else []:
        end = next((j for j, n in enumerate(key) if _is(n, "ASC", "DESC", "NULLS")), len(key))
        if end == 1 and key[0].isdigit() if isinstance(key[0], str) else False:
            sort.append(text(key))
            continue
        name = f"`__key{len(hidden)}`"
        hidden.append(name)
        extra.append(f", {text(key[:end])} AS {name}")
        sort.append(f"{name} {text(key[end:])}")
    inner = Group(["SELECT", *items, *extra, *middle])
    return [*head, f"* EXCEPT ({', '.join(hidden)})", "FROM", inner, "WHERE `__kept`", *(["ORDER BY", ", ".join(sort)] if sort else []), *tail]


def _stage(nodes: list, dialect: str) -> list:
    """A pipe stage in Spark's words."""
    word = nodes[0].upper() if nodes and isinstance(nodes[0], str) else ""
    if word == "DISTINCT":
        return ["SELECT DISTINCT *"]
    if word == "WINDOW":
        return ["EXTEND", *nodes[1:]]
    if word == "RENAME":
        pairs = [(text(x[:1]), text(x[-1:])) for x in split(nodes[1:])]
        return ["EXTEND", ", ".join(f"{a} AS {b}" for a, b in pairs), "|>", "DROP", ", ".join(a for a, _ in pairs)]
    if word in ("CALL", "ASSERT", "LOG", "DESCRIBE", "STATIC_DESCRIBE", "WITH", "IF", "FORK", "TEE", "RECURSIVE", "MATCH_RECOGNIZE", "EXPORT", "CREATE", "INSERT"):
        raise ValueError(f"the pipe stage {word} has no form in Spark SQL: use operators.pipe")
    if word == "AGGREGATE" and (at := next((j for j, n in enumerate(nodes) if _is(n, "GROUP")), None)) is not None and _is(nodes[at + 1] if at + 1 < len(nodes) else "", "AND"):
        keys = [k for k in split(nodes[at + 4 :])]  # GROUP AND ORDER BY
        names = [text(k[-1:]) if not _is(k[-1], "ASC", "DESC") else text(k[:-1]) for k in keys]
        return [*nodes[:at], "GROUP BY", ", ".join(text([n for n in k if not _is(n, "ASC", "DESC")]) for k in keys), "|> ORDER BY", ", ".join(f"{m} DESC" if _is(k[-1], "DESC") else m for m, k in zip(names, keys))]
    return nodes


def _level(nodes: list, dialect: str, types: dict[str, str] | None = None) -> list:
    types = types or {}
    if "|>" in nodes:
        first, *stages = split(nodes, "|>")
        out = _level(first, dialect, types)
        for stage in stages:
            out += ["|>", *_stage(_level(["__stage", *stage], dialect, types)[1:], dialect)]
        return out
    if dialect != "spark":
        nodes = _arrays(nodes) if dialect in ("duckdb", "postgres", "bigquery", "trino") else nodes
    nodes = [Group(_level(n, dialect, types)) if isinstance(n, Group) else n for n in nodes]
    if dialect != "spark":
        nodes = _arithmetic(_subscripts(nodes, dialect), dialect, types)
        nodes = _extremes(nodes, types) if dialect == "duckdb" else nodes
    nodes = _ordered(_expressions(nodes, dialect), dialect)
    if nodes and nodes[0] == "__stage":
        return nodes
    if not any(_is(n, "SELECT") for n in nodes) and not (nodes and dialect == "duckdb" and _is(nodes[0], "FROM")):
        return nodes
    begin = 0
    if _is(nodes[0], "WITH", "INSERT", "CREATE"):
        begin = next(j for j, n in enumerate(nodes) if _is(n, "SELECT"))
    out, core = list(nodes[:begin]), []
    for j, n in enumerate(nodes[begin:], begin):
        joins = _is(n, "UNION", "INTERSECT", "MINUS") or (_is(n, "EXCEPT") and not isinstance(nodes[j + 1] if j + 1 < len(nodes) else None, Group))
        if joins or (core == [] and _is(n, "ALL", "DISTINCT")):
            out += [*_core(core), n] if core else [n]
            core = []
        else:
            core.append(n)
    return out + _core(core)


def resolve_dialect(name: str) -> str:
    """The dialect of an engine's name."""
    name = name.lower().replace("-", "").replace("_", "").replace(" ", "")
    found = DERIVED.get(name, name)
    if found not in DIALECTS:
        raise ValueError(f"unknown dialect {name}: one of {', '.join((*DIALECTS, *DERIVED))}")
    return found


def translate(sql: str, dialect: str, types: dict[str, str] | None = None) -> str:
    """``sql`` of ``dialect`` as Spark SQL; ``types`` maps columns to Spark types where they are known."""
    dialect = resolve_dialect(dialect)
    nodes = lex(sql, dialect)
    while nodes and nodes[-1] == ";":
        nodes.pop()
    return text(_level(nodes, dialect, {k.lower(): v.lower() for k, v in (types or {}).items()}))


def column_types(spark: SparkSession, nodes: list) -> dict[str, str]:
    """Types of the columns of all tables that are named, without names that have several types."""
    names, stack = set(), [nodes]
    while stack:
        for n in stack.pop():
            if isinstance(n, Group):
                stack.append(n)
            elif re.fullmatch(r"`.*`|[^\W\d]\w*", n):
                names.add(n.strip("`"))
    out: dict[str, str] = {}
    for name in sorted(names):
        if spark.catalog.tableExists(name):
            for column, kind in spark.table(name).dtypes:
                column = column.lower()
                out[column] = kind if out.get(column, kind) == kind else ""
    return {k: v for k, v in out.items() if v}


def statements(sql: str, dialect: str) -> list[str]:
    """The statements of a text, without comments and empty ones; a compound BEGIN … END is one."""
    out: list[list] = [[]]
    depth, before = 0, ""
    nodes = list(lex(sql, dialect))
    for n, after in zip(nodes, [*nodes[1:], ";"]):
        if _is(n, "CASE") and before != "END" or _is(n, "BEGIN") and not _is(after, ";", "TRANSACTION", "TRAN", "WORK"):
            depth += 1
        elif _is(n, "END") and depth and not _is(after, "IF", "WHILE", "FOR", "LOOP", "REPEAT"):
            depth -= 1
        before = n.upper() if isinstance(n, str) else ""
        out.append([]) if before == ";" and not depth else out[-1].append(n)
    return [text(nodes) for nodes in out if nodes]


def _placed(nodes: list, orders: list[str]) -> list:
    """Items in which each row_number over all rows is the row's place; ``orders`` takes their ORDER BY."""
    out: list = []
    for n in nodes:
        if isinstance(n, Group):
            over = n if len(out) > 2 and _is(out[-1], "OVER") and out[-2] == Group() and _is(out[-3], "ROW_NUMBER") else None
            if over and _is(over[0], "ORDER") and not any(_is(x, "ROWS", "RANGE") for x in over):
                orders.append(text(over[2:]))
                out[-3:] = ["CAST(`__place` AS INT)"]
                continue
            if not any(_is(x, "SELECT") for x in n):
                n = Group(_placed(n, orders))
                if n[:1] == ["CAST(`__place` AS INT)"] and [x.upper() if isinstance(x, str) else x for x in n[1:]] == ["AS", "BIGINT"]:
                    n[0] = "`__place`"
        out.append(n)
    return out


def _numbered_rows(spark: SparkSession, made: str, args) -> DataFrame | None:
    """A SELECT from one table that numbers all its rows, with places from ranges of the order instead of one task's window; None for others."""
    nodes = lex(made, "spark")
    marks = [j for j, n in enumerate(nodes) if _is(n, *CLAUSES, "UNION", "INTERSECT", "EXCEPT", "MINUS", "WITH", "LATERAL", "JOIN", ";", "|>")]
    words = [nodes[j].upper() for j in marks]
    if words[:2] != ["SELECT", "FROM"] or words[2:] not in ([], ["WHERE"], ["ORDER"], ["WHERE", "ORDER"]) or marks[0] != 0:
        return None
    parts = {w: list(nodes[a + 1 : b]) for w, a, b in zip(words, marks, [*marks[1:], len(nodes)])}
    source, orders = parts["FROM"], []
    items = _placed(parts["SELECT"], orders)
    if len(set(orders)) != 1 or len(source) > 3 or not all(isinstance(n, str) and re.fullmatch(r"`.*`|[^\W\d]\w*", n) for n in source):
        return None
    plan = spark.sql(made, args)._jdf.queryExecution().analyzed()
    below = re.findall(r"^[\s:+-]*(\w+)", plan.toString(), re.MULTILINE)
    below = below[: next((j for j, n in enumerate(below) if n == "SubqueryAlias"), len(below))]
    if plan.isStreaming() or "Aggregate" in below or "Window" not in below:
        return None
    keys, order = [], []
    for k, key in enumerate(split(lex(orders[0], "spark"))):
        end = next((j for j, n in enumerate(key) if _is(n, "ASC", "DESC", "NULLS")), len(key))
        down, last = any(_is(n, "DESC") for n in key[end:]), any(_is(n, "LAST") for n in key[end:])
        last = last or down and not any(_is(n, "FIRST") for n in key[end:])
        keys.append(f"({text(key[:end])}) AS `__key{k}`")
        order.append(getattr(F.col(f"`__key{k}`"), f"{'desc' if down else 'asc'}_nulls_{'last' if last else 'first'}")())
    where = ["WHERE", *parts["WHERE"]] if "WHERE" in parts else []
    rows = spark.sql(text(["SELECT", "*,", ", ".join(keys), "FROM", *source, *where]), args)
    columns = [c for c in rows.columns if not c.startswith("__key")]
    listed = split(items)
    if any(len(x) > 1 and (_is(x[0], "*") or x[1] == "." and _is(x[2], "*")) for x in listed):
        return None
    listed = [[", ".join(f"`{c}`" for c in columns)] if x == ["*"] else x for x in listed]
    used, stack = set(), [[*items, *parts.get("ORDER", [])]]
    while stack:
        for n in stack.pop():
            stack.append(n) if isinstance(n, Group) else used.add(n.strip("`").lower())
    rows = rows.select(*(f"`{c}`" for c in columns if c.lower() in used or ["*"] in split(items)), *(f"`__key{k}`" for k in range(len(keys))))
    placed = joins.numbered(rows, order, "__at").withColumn("__place", F.col("__at") + 1).drop("__at")
    name = f"__rows_{uuid.uuid4().hex}"
    placed.createOrReplaceTempView(name)
    try:
        tail = ["ORDER", *parts["ORDER"]] if "ORDER" in parts else []
        return spark.sql(text(["SELECT", ", ".join(map(text, listed)), "FROM", name, "AS", source[-1], *tail]), args)
    finally:
        spark.catalog.dropTempView(name)


def run(spark: SparkSession, sql: str, dialect: str, args=None) -> DataFrame:
    """The result of a query in ``dialect`` over the session's tables and views; ``@x``, ``$1`` and ``:x`` are named x, p1 and x in ``args``.

    A ``row_number() OVER (ORDER BY …)`` of all rows of one table comes from ranges of the order, which are written at once.
    """
    made = translate(sql, dialect, column_types(spark, lex(sql, resolve_dialect(dialect))))
    placed = _numbered_rows(spark, made, args) if re.search(r"row_number\s*\(", made, re.I) else None
    return spark.sql(made, args) if placed is None else placed
