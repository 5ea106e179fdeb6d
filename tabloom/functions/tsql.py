"""Row expressions in SQL Server's style (and a little of SQLite's), translated to columns.

Given ``kind`` (the type of a column over the table, by analysis), every part of
an expression has a kind, and values meet as in SQL Server: ``/`` of whole numbers
is whole, ``+`` of texts joins them and with a missing one gives none, a truth
value is 0 or 1 beside numbers, days are added to dates, and numbers become text
without idle zeros. Without it columns are of any kind and left as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.parse import ExpressionError, Node, Parser, names_in
from tabloom.functions.rtypes import NUMBERS, Typed, kind_of, number_of, number_text


class SqlParser(Parser):
    pattern = re.compile(
        r"""(?P<space>\s+)|(?P<number>(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)|(?P<string>N?'(''|[^'])*')|(?P<quoted>\[[^\]]+\]|"[^"]+"|`[^`]+`)"""
        r"""|(?P<word>[^\W\d][\w$#@]*)|(?P<op>\|\||<>|!=|<=|>=|[-+*/%=<>(),.])"""
    )
    infix = {
        "OR": (1, 2), "AND": (3, 4), "=": (7, 8), "<>": (7, 8), "!=": (7, 8), "<": (7, 8), "<=": (7, 8), ">": (7, 8), ">=": (7, 8),
        "IS": (7, 8), "IN": (7, 8), "NOT": (7, 8), "LIKE": (7, 8), "BETWEEN": (7, 8),
        "+": (9, 10), "-": (9, 10), "||": (9, 10), "*": (11, 12), "/": (11, 12), "%": (11, 12),
    }
    prefix = {"NOT": 5, "-": 13, "+": 13}

    def combine(self, op, left):
        negated = op == "NOT"
        if negated:
            op = self.take().text.upper()
            if op not in ("IN", "LIKE", "BETWEEN"):
                raise ExpressionError(f"unexpected NOT before {op} in {self.text!r}")
        if op == "IS":
            negated = self.accept("NOT")
            self.expect("NULL")
            node = Node("unary", "ISNULL", [left])
        elif op == "IN":
            self.expect("(")
            node = Node("call", "IN", [left, *self.arguments()[0]])
        elif op == "BETWEEN":
            low = self.expression(9)
            self.expect("AND")
            node = Node("call", "BETWEEN", [left, low, self.expression(9)])
        else:
            node = Node("binary", op, [left, self.expression(self.infix[op][1])])
        return Node("unary", "NOT", [node]) if negated else node

    def atom(self, token):
        if token.kind == "string":
            return Node("string", token.text[token.text.index("'") + 1 : -1].replace("''", "'"))
        if token.kind not in ("word", "quoted"):
            return super().atom(token)
        word = token.text.upper()
        if token.kind == "word":
            if word == "NULL":
                return Node("null")
            if word == "CASE":
                return self._case()
            if word in ("CAST", "TRY_CAST"):
                self.expect("(")
                value = self.expression(0)
                self.expect("AS")
                return Node("call", "CAST", [value, Node("type", self._type())])
            if word in ("CONVERT", "TRY_CONVERT"):
                self.expect("(")
                kind = self._type(",")
                value = self.expression(0)
                style = [self.expression(0)] if self.accept(",") else []
                self.expect(")")
                return Node("call", "CAST", [value, Node("type", kind), *style])
            if self.accept("("):
                return Node("call", word, self.arguments()[0])
        parts = [token.text.strip('[]"`')]
        while self.accept("."):
            parts.append(self.take().text.strip('[]"`'))
        return Node("name", parts[-1])

    def _type(self, end: str = ")") -> str:
        words, depth = [], 0
        while depth or self.peek().text != end:
            token = self.take()
            if token.kind == "end":
                raise ExpressionError(f"type not closed in {self.text!r}")
            depth += {"(": 1, ")": -1}.get(token.text, 0)
            words.append(token.text)
        self.take()
        return "".join(words)

    def _case(self) -> Node:
        subject = None if self.peek().text.upper() == "WHEN" else self.expression(0)
        args = []
        while self.accept("WHEN"):
            test = self.expression(0)
            self.expect("THEN")
            args += [test if subject is None else Node("binary", "=", [subject, test]), self.expression(0)]
        other = self.expression(0) if self.accept("ELSE") else Node("null")
        self.expect("END")
        if not args:
            raise ExpressionError(f"CASE without WHEN in {self.text!r}")
        return Node("case", other, args)


_COMPARE = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.when(b != 0, a % b),
}

_PARTS = {"YEAR": 12, "YY": 12, "YYYY": 12, "QUARTER": 3, "QQ": 3, "Q": 3, "MONTH": 1, "MM": 1, "M": 1}
_DAYS = {"DAY": 1, "DD": 1, "D": 1, "WEEK": 7, "WK": 7, "WW": 7}
_CLOCK = {"HOUR": "HOUR", "HH": "HOUR", "MINUTE": "MINUTE", "MI": "MINUTE", "N": "MINUTE", "SECOND": "SECOND", "SS": "SECOND", "S": "SECOND"}
_SECONDS = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _part(node: Node) -> str:
    if node.kind != "name":
        raise ExpressionError("a date part is expected")
    return node.value.upper()


def _date(c: Column) -> Column:
    return c.try_cast("date")


def _dateadd(part: str, n: Column, x: Column) -> Column:
    if part in _PARTS:
        return F.add_months(_date(x), (n * _PARTS[part]).cast("int"))
    if part in _DAYS:
        return F.date_add(_date(x), (n * _DAYS[part]).cast("int"))
    if part in _CLOCK:
        return F.timestamp_add(_CLOCK[part], n.cast("bigint"), x.try_cast("timestamp"))
    raise ExpressionError(f"date part {part} is not supported")


def _datediff(part: str, a: Column, b: Column) -> Column:
    """Boundaries crossed from a to b; weeks begin on Sunday."""
    if part in _CLOCK:
        unit = _CLOCK[part]
        a, b = (F.unix_seconds(F.date_trunc(unit, x.try_cast("timestamp"))) for x in (a, b))
        return ((b - a) / _SECONDS[unit]).cast("bigint")
    a, b = _date(a), _date(b)
    if part in ("WEEK", "WK", "WW"):
        sunday = F.lit("1899-12-31").cast("date")
        a, b = (F.floor(F.datediff(x, sunday) / 7) for x in (a, b))
        return (b - a).cast("int")
    if part in ("DAY", "DD", "D"):
        return F.datediff(b, a)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if part in ("MONTH", "MM", "M"):
        return months
    if part in ("YEAR", "YY", "YYYY"):
        return F.year(b) - F.year(a)
    if part in ("QUARTER", "QQ", "Q"):
        return (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    raise ExpressionError(f"date part {part} is not supported")


def _sqlite_date(x: Column, *changes: Node) -> Column:
    out = _date(x)
    for change in changes:
        m = re.fullmatch(r"([+-]?\d+)\s+(year|month|day)s?", str(change.value).strip().lower()) if change.kind == "string" else None
        if not m:
            raise ExpressionError("DATE() changes look like '-1 years'")
        out = _dateadd(m[2].upper(), F.lit(int(m[1])), out)
    return out


#: Names of date parts, and layouts of the styles of CONVERT.
_FIELDS = {
    "YEAR": "YEAR", "YY": "YEAR", "YYYY": "YEAR", "QUARTER": "QUARTER", "QQ": "QUARTER", "Q": "QUARTER", "MONTH": "MONTH", "MM": "MONTH", "M": "MONTH", "DAYOFYEAR": "DAYOFYEAR", "DY": "DAYOFYEAR", "Y": "DAYOFYEAR",
    "DAY": "DAY", "DD": "DAY", "D": "DAY", "WEEK": "WEEK", "WK": "WEEK", "WW": "WEEK", "WEEKDAY": "WEEKDAY", "DW": "WEEKDAY", "ISO_WEEK": "ISO_WEEK", "ISOWK": "ISO_WEEK", "HOUR": "HOUR", "HH": "HOUR",
    "MINUTE": "MINUTE", "MI": "MINUTE", "N": "MINUTE", "SECOND": "SECOND", "SS": "SECOND", "S": "SECOND",
}
_STYLES = {
    1: "MM/dd/yy", 2: "yy.MM.dd", 3: "dd/MM/yy", 4: "dd.MM.yy", 5: "dd-MM-yy", 10: "MM-dd-yy", 11: "yy/MM/dd", 12: "yyMMdd", 23: "yyyy-MM-dd", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy",
    104: "dd.MM.yyyy", 105: "dd-MM-yyyy", 106: "dd MMM yyyy", 107: "MMM dd, yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 113: "dd MMM yyyy HH:mm:ss:SSS",
    114: "HH:mm:ss:SSS", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def _field(part: str, x: Column) -> Column:
    day = _date(x)
    return {
        "YEAR": lambda: F.year(day), "QUARTER": lambda: F.quarter(day), "MONTH": lambda: F.month(day), "DAYOFYEAR": lambda: F.dayofyear(day), "DAY": lambda: F.dayofmonth(day),
        # the week that has the first of January is the first, and weeks begin on Sunday
        "WEEK": lambda: F.floor((F.dayofyear(day) - 1 + F.dayofweek(F.trunc(day, "year")) - 1) / 7).cast("int") + 1,
        "WEEKDAY": lambda: F.dayofweek(day), "ISO_WEEK": lambda: F.weekofyear(day), "HOUR": lambda: F.hour(x.try_cast("timestamp")), "MINUTE": lambda: F.minute(x.try_cast("timestamp")), "SECOND": lambda: F.second(x.try_cast("timestamp")),
    }[part]()


def _name_of_field(part: str, x: Column) -> Column:
    layout = {"MONTH": "MMMM", "WEEKDAY": "EEEE"}.get(part)
    return F.date_format(_date(x), layout) if layout else _field(part, x).cast("string")


def text_of(t: Typed) -> Column:
    if t.kind == "bool":
        return t.column.cast("int").cast("string")
    return number_text(t.column) if t.kind == "double" else t.column.cast("string")


def _meet(values: list[Typed]) -> tuple[list[Column], str]:
    """Truth values are numbers beside numbers; the engine turns text into what it meets, as SQL Server does."""
    kinds = {t.kind for t in values} - {"null"}
    if kinds <= set(NUMBERS) and len(kinds) > 1:
        return [number_of(t).column if t.kind != "null" else t.column for t in values], next(k for k in ("double", "decimal", "int") if k in kinds)
    order = ("time", "date", "double", "decimal", "int", "bool", "text")
    return [t.column for t in values], "any" if "any" in kinds else next((k for k in order if k in kinds), "null")


def like(x: Column, pattern: str) -> Column:
    """With sets of characters in brackets, as SQL Server has them."""
    return x.like(pattern) if "[" not in pattern else x.rlike(f"(?s)^{_regex(pattern)}$")


def _regex(pattern: str) -> str:
    out = []
    for part in re.findall(r"\[[^\]]+\]|.", pattern, re.S):
        if len(part) > 1:
            inner = part[1:-1]
            negated = "^" if inner.startswith("^") and len(inner) > 1 else ""
            out.append(f"[{negated}" + re.sub(r"([\\\[\]&^])", r"\\\1", inner[len(negated) :]) + "]")
        else:
            out.append({"%": ".*", "_": "."}.get(part, re.escape(part)))
    return "".join(out)


def _patindex(node: Node, x: Column) -> Column:
    pattern = _literal(node)
    inner = pattern[1:] if pattern.startswith("%") else pattern
    body = _regex(inner[:-1] if inner.endswith("%") else inner)
    start, end = "" if pattern.startswith("%") else "^", "" if pattern.endswith("%") else "$"
    return F.regexp_instr(x, F.lit(f"{start}({body}){end}"))


def _layout(t: Typed, layout: str) -> Column:
    """FORMAT: a number with so many decimals, or a date by a pattern."""
    if t.kind in ("date", "time"):
        if set(re.sub(r"'[^']*'", "", layout)) & set("abceghijklnopqruvwxzABCDEFGIJKLNOPQRSTUVWXYZ"):
            raise ExpressionError(f"FORMAT() does not know {layout!r}")
        names = {"ddd": "EEE", "dddd": "EEEE"}
        return F.date_format(t.column, re.sub(r"d{3,4}", lambda m: names[m[0]], layout))
    if m := re.fullmatch(r"[NF](\d*)", layout, re.I):
        digits = int(m[1] or 2)
        return F.format_number(t.column, digits) if layout[0] in "Nn" else F.format_string(f"%.{digits}f", t.column.cast("double"))
    if re.fullmatch(r"0+(\.0+)?", layout):
        whole, _, part = layout.partition(".")
        return F.format_string(f"%0{len(layout)}.{len(part)}f" if len(whole) > 1 else f"%.{len(part)}f", t.column.cast("double"))
    raise ExpressionError(f"FORMAT() does not know {layout!r}")


def _same(fn):
    def run(*values: Typed) -> Typed:
        columns, kind = _meet(list(values))
        return Typed(fn(*columns), kind)

    return run


def _gives(kind: str, fn):
    return lambda *x: Typed(fn(*(t.column for t in x)), kind)


def _text(fn, kind: str = "text"):
    """Of a value as text, with others as they are."""
    return lambda x, *more: Typed(fn(text_of(x) if x.kind != "any" else x.column, *(t.column for t in more)), kind)


def _number(fn, kind: str | None = None):
    return lambda x, *more: (lambda n: Typed(fn(n.column, *(t.column for t in more)), kind or n.kind))(x if x.kind == "text" else number_of(x))


_CALLS: dict[str, tuple[int, int, Callable]] = {
    "IIF": (3, 3, lambda c, a, b: _same(lambda x, y: F.when(c.column, x).otherwise(y))(a, b)),
    "CHOOSE": (2, 99, lambda i, *x: _same(lambda *v: F.try_element_at(F.array(*v), F.when(i.column > 0, i.column).otherwise(F.lit(len(v) + 1)).cast("int")))(*x)),
    "COALESCE": (1, 99, _same(F.coalesce)), "ISNULL": (2, 2, _same(F.coalesce)), "IFNULL": (2, 2, _same(F.coalesce)), "NULLIF": (2, 2, _same(F.nullif)), "GREATEST": (2, 99, _same(F.greatest)), "LEAST": (2, 99, _same(F.least)),
    "YEAR": (1, 1, _gives("int", lambda x: F.year(_date(x)))), "MONTH": (1, 1, _gives("int", lambda x: F.month(_date(x)))), "DAY": (1, 1, _gives("int", lambda x: F.dayofmonth(_date(x)))),
    "JULIANDAY": (1, 1, _gives("double", lambda x: F.datediff(_date(x), F.lit("1970-01-01").cast("date")) + 2440587.5)),
    "DATEFROMPARTS": (3, 3, _gives("date", lambda y, m, d: F.make_date(y, m, d))), "EOMONTH": (1, 2, _gives("date", lambda x, n=None: F.last_day(_date(x) if n is None else F.add_months(_date(x), n.cast("int"))))),
    "ISDATE": (1, 1, _gives("int", lambda x: F.coalesce(x.cast("string").try_cast("timestamp").isNotNull(), F.lit(False)).cast("int"))), "ISNUMERIC": (1, 1, _gives("int", lambda x: F.coalesce(x.cast("string").try_cast("double").isNotNull(), F.lit(False)).cast("int"))),
    "ABS": (1, 1, _number(F.abs)), "FLOOR": (1, 1, _number(F.floor)), "CEILING": (1, 1, _number(F.ceil)), "SQRT": (1, 1, _number(F.sqrt, "double")), "POWER": (2, 2, _number(F.pow, "double")), "SIGN": (1, 1, _number(F.signum)), "SQUARE": (1, 1, _number(lambda x: x * x)),
    "EXP": (1, 1, _number(F.exp, "double")), "LOG10": (1, 1, _number(lambda x: F.when(x > 0, F.log10(x)), "double")), "PI": (0, 0, lambda: Typed(F.pi(), "double")),
    "LOG": (1, 2, _number(lambda x, base=None: F.when(x > 0, F.ln(x) if base is None else F.try_divide(F.ln(x), F.ln(base))), "double")),
    "LEN": (1, 1, _text(lambda x: F.length(F.rtrim(x)), "int")), "LENGTH": (1, 1, _text(F.length, "int")), "UPPER": (1, 1, _text(F.upper)), "LOWER": (1, 1, _text(F.lower)),
    "LTRIM": (1, 1, _text(F.ltrim)), "RTRIM": (1, 1, _text(F.rtrim)), "TRIM": (1, 1, _text(F.trim)), "REVERSE": (1, 1, _text(F.reverse)), "REPLICATE": (2, 2, _text(lambda x, n: F.when(n >= 0, F.repeat(x, n.cast("int"))))), "SPACE": (1, 1, _gives("text", lambda n: F.repeat(F.lit(" "), n.cast("int")))),
    "CONCAT": (1, 99, lambda *x: Typed(F.concat(*(F.coalesce(text_of(t), F.lit("")) for t in x)), "text")), "CONCAT_WS": (2, 99, lambda sep, *x: Typed(F.call_function("concat_ws", sep.column, *map(text_of, x)), "text")),
    "SUBSTRING": (3, 3, _text(lambda x, a, n: F.substring(x, a.cast("int"), n.cast("int")))), "REPLACE": (3, 3, _text(F.replace)), "TRANSLATE": (3, 3, _text(lambda x, a, b: F.call_function("translate", x, a, b))),
    "LEFT": (2, 2, _text(lambda x, n: F.left(x, n))), "RIGHT": (2, 2, _text(lambda x, n: F.right(x, n))), "ASCII": (1, 1, _text(F.ascii, "int")), "UNICODE": (1, 1, _text(F.ascii, "int")), "CHAR": (1, 1, _gives("text", lambda n: F.char(n.cast("bigint")))),
    "CHARINDEX": (2, 3, _gives("int", lambda what, x, start=None: F.position(what, x, F.lit(1) if start is None else start))),
    "STUFF": (4, 4, _text(lambda x, a, n, new: F.overlay(x, new, a.cast("int"), n.cast("int")))), "STR": (1, 1, lambda x: Typed(F.lpad(F.bround(x.column, 0).cast("bigint").cast("string"), 10, " "), "text")),
    "GETDATE": (0, 0, lambda: Typed(F.current_timestamp(), "time")), "SYSDATETIME": (0, 0, lambda: Typed(F.current_timestamp(), "time")),
    "IN": (2, 999, lambda *x: (lambda c: Typed(c[0].isin(*c[1:]), "bool"))(_meet(list(x))[0])), "BETWEEN": (3, 3, lambda *x: (lambda c: Typed(c[0].between(c[1], c[2]), "bool"))(_meet(list(x))[0])),
}


def compile_node(node: Node, resolve: Callable[[str], Column], kind: Callable[[Column], str] | None = None) -> Typed:
    go = lambda n: compile_node(n, resolve, kind)
    if node.kind in ("number", "string"):
        return Typed(F.lit(node.value), "text" if node.kind == "string" else "int" if isinstance(node.value, int) else "double")
    if node.kind == "null":
        return Typed(F.lit(None), "null")
    if node.kind == "name":
        found = resolve(node.value)
        return Typed(found, kind_of(kind(found)) if kind else "any")
    if node.kind == "unary":
        inner = go(node.args[0])
        if node.value == "ISNULL":
            return Typed(inner.column.isNull(), "bool")
        if node.value == "NOT":
            return Typed(~inner.column, "bool")
        inner = inner if inner.kind == "text" else number_of(inner, node.value)
        return Typed(-inner.column, inner.kind) if node.value == "-" else inner
    if node.kind == "binary":
        return _binary(node, go)
    if node.kind == "case":
        tests = [go(t).column for t in node.args[::2]]
        values, of = _meet([go(v) for v in (*node.args[1::2], node.value)])
        out = None
        for test, value in zip(tests, values, strict=False):
            out = F.when(test, value) if out is None else out.when(test, value)
        return Typed(out.otherwise(values[-1]), of)
    return _call(node, go)


def _binary(node: Node, go) -> Typed:
    op = node.value
    a = go(node.args[0])
    if op == "LIKE":
        return Typed(like(text_of(a) if a.kind != "any" else a.column, _literal(node.args[1])), "bool")
    b = go(node.args[1])
    if op in ("AND", "OR"):
        return Typed(a.column & b.column if op == "AND" else a.column | b.column, "bool")
    if op == "||":
        return Typed(F.concat(a.column, b.column), "text")
    if op in _COMPARE:
        (x, y), _ = _meet([a, b])
        return Typed(_COMPARE[op](x, y), "bool")
    kinds = {a.kind, b.kind}
    if op == "+" and kinds <= {"text", "null"}:
        return Typed(F.concat(*(x.column.cast("string") for x in (a, b))), "text")
    if op in "+-" and a.kind in ("date", "time") and b.kind in (*NUMBERS, "null"):
        days = number_of(b).column
        shifted = F.date_add(a.column, (days if op == "+" else -days).cast("int")) if a.kind == "date" else a.column + F.make_dt_interval(days=(days if op == "+" else -days).cast("int"))
        return Typed(shifted, a.kind)
    if "null" in kinds and kinds & {"date", "time", "text"}:
        return Typed(F.lit(None), "null")
    (x, y), of = _meet([a, b])
    if a.kind == b.kind == "bool":
        (x, y), of = [number_of(t).column for t in (a, b)], "int"
    if op == "/" and kinds <= {"int", "bool"}:
        return Typed(F.when(y != 0, F.call_function("div", x, y)), "int")
    return Typed(_ARITHMETIC[op](x, y), "double" if op == "/" and of == "int" else of)


def _literal(node: Node) -> str:
    if node.kind != "string":
        raise ExpressionError("a pattern or a layout is a text")
    return node.value


def _cast(t: Typed, name: str, style: Node | None) -> Typed:
    from tabloom.operators.types import spark_type, text_length

    to = spark_type(name)
    of = kind_of(to)
    if style is not None:
        if style.kind != "number" or (style.value not in _STYLES and (of in ("text", "date", "time") and t.kind != "any")):
            raise ExpressionError(f"CONVERT() does not know style {style.value}")
        layout = _STYLES.get(style.value)
        if layout and of == "text":
            out = F.date_format(t.column.try_cast("timestamp") if t.kind in ("text", "any") else t.column, layout)
            return Typed(_shortened(out, text_length(name)), "text")
        if layout and of in ("date", "time") and t.kind in ("text", "any"):
            return Typed(F.try_to_timestamp(t.column.cast("string"), F.lit(layout)).cast(to), of)
    if of == "text" and t.kind != "any":
        return Typed(_shortened(text_of(t), text_length(name)), "text")
    return Typed(t.column.try_cast(to), of)


def _shortened(x: Column, n: int | None) -> Column:
    return F.substring(x, 1, n) if n else x


def _call(node: Node, go) -> Typed:
    name, args = node.value, node.args
    if name == "CAST":
        return _cast(go(args[0]), args[1].value, args[2] if len(args) > 2 else None)
    if name in ("DATEADD", "DATEDIFF"):
        if len(args) != 3:
            raise ExpressionError(f"{name}() takes three arguments")
        part = _part(args[0])
        out = (_dateadd if name == "DATEADD" else _datediff)(part, go(args[1]).column, go(args[2]).column)
        return Typed(out, "int" if name == "DATEDIFF" else "time" if part in _CLOCK else "date")
    if name in ("DATEPART", "DATENAME"):
        part = _FIELDS.get(_part(args[0])) if len(args) == 2 else None
        if part is None:
            raise ExpressionError(f"{name}() takes a date part and a date")
        x = go(args[1]).column
        return Typed(_field(part, x), "int") if name == "DATEPART" else Typed(_name_of_field(part, x), "text")
    if name == "DATE":
        return Typed(_sqlite_date(go(args[0]).column, *args[1:]), "date")
    if name == "ROUND":
        if len(args) != 2 or args[1].kind != "number":
            raise ExpressionError("ROUND() takes a value and a number of digits")
        x = number_of(go(args[0]), "ROUND()")
        return Typed(F.round(x.column, int(args[1].value)), x.kind)
    if name == "FORMAT":
        if len(args) != 2:
            raise ExpressionError("FORMAT() takes a value and a layout")
        return Typed(_layout(go(args[0]), _literal(args[1])), "text")
    if name == "PATINDEX":
        if len(args) != 2:
            raise ExpressionError("PATINDEX() takes a pattern and a text")
        return Typed(_patindex(args[0], go(args[1]).column), "int")
    if name not in _CALLS:
        raise ExpressionError(f"unknown function {name}()")
    least, most, fn = _CALLS[name]
    if not least <= len(args) <= most:
        raise ExpressionError(f"{name}() takes {least} to {most} arguments")
    return fn(*(go(a) for a in args))


def to_column(text: str, resolve: Callable[[str], Column], kind: Callable[[Column], str] | None = None) -> Column:
    return compile_node(SqlParser(text).parse(), resolve, kind).column


def columns_read(text: str) -> set[str]:
    """Names that are read, without date parts."""

    def walk(node: Node) -> set[str]:
        skip = 1 if node.kind == "call" and node.value in ("DATEADD", "DATEDIFF", "DATEPART", "DATENAME") else 0
        inner = [a for a in node.args[skip:] if isinstance(a, Node)] + ([node.value] if isinstance(node.value, Node) else [])
        return ({node.value} if node.kind == "name" else set()).union(*map(walk, inner))

    return walk(SqlParser(text).parse())


__all__ = ["SqlParser", "columns_read", "names_in", "to_column"]
