"""Row expressions in the style of R, translated to columns.

Missing values behave as in R: a missing condition gives a missing result, and
``%in%`` never does. Division by zero gives a missing value.

Every part of an expression has a kind, known from the table's types, and values
are turned into the kind that an operator or a function takes before columns are
made of it: a number beside a text is compared as text, truth values count as 0
and 1, and numbers become text as R writes them. Where only the table's names
are given, its columns are of any kind and left as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.parse import ExpressionError, Node, Parser, names_in, number
from tabloom.functions.rtypes import Typed, alike, kind_of, number_of, pasted, text_of, truth_of


class RParser(Parser):
    pattern = re.compile(
        r"""(?P<space>\s+)|(?P<number>(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?L?)|(?P<string>"(\\.|[^"\\])*"|'(\\.|[^'\\])*')"""
        r"""|(?P<quoted>`[^`]+`)|(?P<word>[^\W\d][\w.]*|\.[^\W\d][\w.]*)|(?P<op>%[^%\s]*%|::|:|==|!=|<=|>=|&&|\|\||[-+*/^<>!&|(),~=])"""
    )
    infix = {
        "~": (1, 2), "||": (3, 4), "|": (3, 4), "&&": (5, 6), "&": (5, 6),
        "==": (9, 10), "!=": (9, 10), "<": (9, 10), "<=": (9, 10), ">": (9, 10), ">=": (9, 10),
        "+": (11, 12), "-": (11, 12), "*": (13, 14), "/": (13, 14),
        "%%": (15, 16), "%/%": (15, 16), "%in%": (15, 16), "%not_in%": (15, 16), ":": (17, 18), "^": (20, 19),
    }
    prefix = {"!": 7, "-": 19, "+": 19}
    named_arguments = True

    def start(self):
        if self.peek().kind == "number":
            text = self.take().text
            return Node("whole" if text.endswith("L") else "number", number(text))
        return super().start()

    def atom(self, token):
        if token.kind == "string":
            return Node("string", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token.text[1:-1]))
        if token.kind == "quoted":
            return Node("name", token.text[1:-1])
        if token.kind == "word":
            if self.accept("::"):
                return self.atom(self.take())
            if self.accept("("):
                args, names = self.arguments()
                return Node("vector", None, args) if token.text == "c" else Node("call", token.text, args, names)
            if token.text in ("TRUE", "FALSE", "T", "F"):
                return Node("bool", token.text[0] == "T")
            if token.text == "NULL" or re.fullmatch(r"NA(_\w+_)?", token.text):
                return Node("null")
            return Node("name", token.text)
        return super().atom(token)


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _floor_mod(a: Column, b: Column) -> Column:
    """With the sign of the divisor; whole numbers stay exact."""
    return F.when(b != 0, (a % b + b) % b)


def ifelse(test: Column, yes: Column, no: Column) -> Column:
    """Neither branch where the test is missing."""
    return F.when(test, yes).when(~test, no)


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "^": lambda a, b: F.pow(a, b),
    "%%": _floor_mod, "%/%": lambda a, b: F.floor(_divide(a, b)),
}
_LOGIC = {"&": lambda a, b: a & b, "&&": lambda a, b: a & b, "|": lambda a, b: a | b, "||": lambda a, b: a | b}


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in _COMPARE:
        (x, y), _ = alike((a, b), compared=True)
        return Typed(_COMPARE[op](x, y), "bool")
    if op in _LOGIC:
        return Typed(_LOGIC[op](truth_of(a), truth_of(b)), "bool")
    if op in "+-" and (a.kind == "date" or (op == "+" and b.kind == "date")):
        return _days(op, a, b)
    a, b = number_of(a, op), number_of(b, op)
    whole = a.kind == b.kind == "int" and op not in "/^"
    return Typed(_ARITHMETIC[op](a.column, b.column), "any" if "any" in (a.kind, b.kind) else "int" if whole else "double")


def _days(op: str, a: Typed, b: Typed) -> Typed:
    """A date and a number of days, or the days between two dates."""
    if a.kind == b.kind:
        if op == "+":
            raise ExpressionError("dates can't be added")
        return Typed(F.datediff(a.column, b.column), "int")
    date, days = (a, b) if a.kind == "date" else (b, a)
    n = F.floor(number_of(days, op).column).cast("int")
    return Typed(F.date_add(date.column, -n if op == "-" else n), "date")


def _math(fn, kind: str | None = None):
    """Of one number; the result's kind is the number's unless given."""
    return lambda x: (lambda n: Typed(fn(n.column), kind or n.kind))(number_of(x, "a function of numbers"))


def _of_text(fn, kind: str = "text"):
    """Of a value as text, with others as they are."""
    return lambda x, *more: Typed(fn(text_of(x), *(m.column for m in more)), kind)


def _same(fn, compared: bool = False):
    """Of values of one kind, which is the result's too."""

    def run(*values: Typed) -> Typed:
        columns, kind = alike(values, compared)
        return Typed(fn(*columns), kind)

    return run


def _truth(fn):
    return lambda *x: Typed(fn(*map(truth_of, x)), "bool")


def _date(x: Typed) -> Column:
    return x.column.try_cast("date") if x.kind in ("text", "null") else x.column


def _of_date(fn, kind: str = "int"):
    return lambda x: Typed(fn(_date(x)), kind)


def _numeric(x: Typed) -> Column:
    return x.column.cast("double") if x.kind == "bool" else x.column.try_cast("double")


def _between(x: Typed, a: Typed, b: Typed) -> Typed:
    (x, a, b), _ = alike((x, a, b), compared=True)
    return Typed((x >= a) & (x <= b), "bool")


def _ifelse(test: Typed, yes: Typed, no: Typed) -> Typed:
    (yes, no), kind = alike((yes, no))
    return Typed(ifelse(truth_of(test), yes, no), kind)


_SIMPLE = {
    "is.na": (1, 1, lambda x: Typed(x.column.isNull(), "bool")),
    "is.numeric": (1, 1, lambda x: Typed(F.typeof(x.column).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), "bool")),
    "is.character": (1, 1, lambda x: Typed(F.typeof(x.column) == "string", "bool")), "is.logical": (1, 1, lambda x: Typed(F.typeof(x.column) == "boolean", "bool")),
    "is.nan": (1, 1, lambda x: Typed(F.coalesce(F.isnan(number_of(x).column.cast("double")), F.lit(False)), "bool")),
    "is.finite": (1, 1, lambda x: Typed(F.coalesce(F.abs(number_of(x).column.cast("double")) < float("inf"), F.lit(False)), "bool")),
    "ifelse": (3, 3, _ifelse), "if_else": (3, 3, _ifelse),
    "coalesce": (1, 99, _same(F.coalesce)), "replace_na": (2, 2, _same(F.coalesce)),
    "abs": (1, 1, _math(F.abs)), "floor": (1, 1, _math(F.floor)), "ceiling": (1, 1, _math(F.ceil)), "trunc": (1, 1, _math(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))),
    "sqrt": (1, 1, _math(lambda x: F.when(x >= 0, F.sqrt(x)), "double")), "exp": (1, 1, _math(F.exp, "double")), "sign": (1, 1, _math(F.signum)),
    "log10": (1, 1, _math(lambda x: F.when(x > 0, F.log10(x)), "double")), "log2": (1, 1, _math(lambda x: F.when(x > 0, F.log2(x)), "double")), "log1p": (1, 1, _math(lambda x: F.when(x > -1, F.log1p(x)), "double")), "expm1": (1, 1, _math(F.expm1, "double")),
    "nchar": (1, 1, _of_text(F.length, "int")), "str_length": (1, 1, _of_text(F.length, "int")),
    "toupper": (1, 1, _of_text(F.upper)), "tolower": (1, 1, _of_text(F.lower)), "trimws": (1, 1, _of_text(F.trim)), "str_trim": (1, 1, _of_text(F.trim)),
    "str_to_upper": (1, 1, _of_text(F.upper)), "str_to_lower": (1, 1, _of_text(F.lower)),
    "substr": (3, 3, _of_text(lambda x, a, b: F.substring(x, a.cast("int"), (b - a + 1).cast("int")))), "substring": (3, 3, _of_text(lambda x, a, b: F.substring(x, a.cast("int"), (b - a + 1).cast("int")))),
    "strrep": (2, 2, _of_text(lambda x, n: F.repeat(x, n.cast("int")))),
    "as.numeric": (1, 1, lambda x: Typed(_numeric(x), "double")), "as.double": (1, 1, lambda x: Typed(_numeric(x), "double")),
    "as.integer": (1, 1, lambda x: Typed(F.when(x.column.isNotNull(), _numeric(x).try_cast("long")), "int")),
    "as.character": (1, 1, lambda x: Typed(text_of(x), "text")), "as.logical": (1, 1, _truth(lambda x: x)),
    "as.Date": (1, 1, lambda x: Typed(x.column.try_cast("date"), "date")),
    "paste0": (1, 99, lambda *x: Typed(F.concat(*map(pasted, x)), "text")),
    "pmin": (2, 99, _same(lambda *x: F.when(_all_there(x), F.least(*x)))), "pmax": (2, 99, _same(lambda *x: F.when(_all_there(x), F.greatest(*x)))),
    "between": (3, 3, _between),
    "year": (1, 1, _of_date(F.year)), "month": (1, 1, _of_date(F.month)), "day": (1, 1, _of_date(F.dayofmonth)), "mday": (1, 1, _of_date(F.dayofmonth)), "yday": (1, 1, _of_date(F.dayofyear)), "quarter": (1, 1, _of_date(F.quarter)),
    "weekdays": (1, 1, _of_date(lambda x: F.date_format(x, "EEEE"), "text")), "months": (1, 1, _of_date(lambda x: F.date_format(x, "MMMM"), "text")),
    "startsWith": (2, 2, lambda x, y: Typed(text_of(x).startswith(text_of(y)), "bool")), "endsWith": (2, 2, lambda x, y: Typed(text_of(x).endswith(text_of(y)), "bool")),
    "xor": (2, 2, _truth(lambda a, b: (a | b) & ~(a & b))), "isTRUE": (1, 1, _truth(lambda x: F.coalesce(x, F.lit(False)))), "na_if": (2, 2, _same(F.nullif)),
}


def _all_there(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def _digits(node: Node) -> int:
    sign = -1 if node.kind == "unary" and node.value == "-" else 1
    inner = node.args[0] if node.kind == "unary" else node
    if inner.kind not in ("number", "whole") or int(inner.value) != inner.value:
        raise ExpressionError("round() takes a whole number of digits")
    return sign * int(inner.value)


def compile_node(node: Node, columns: dict[str, tuple[str, str]]) -> Typed:
    """columns: lower-case name to the name in the table and its kind."""
    go = lambda n: compile_node(n, columns)
    if node.kind in ("number", "whole", "string", "bool"):
        return Typed(F.lit(node.value), {"number": "double", "whole": "int", "string": "text", "bool": "bool"}[node.kind])
    if node.kind == "null":
        return Typed(F.lit(None), "null")
    if node.kind == "name":
        if node.value.lower() not in columns:
            raise ExpressionError(f"unknown column {node.value!r}")
        name, kind = columns[node.value.lower()]
        return Typed(F.col(quote(name)), kind)
    if node.kind == "unary":
        inner = go(node.args[0])
        if node.value == "!":
            return Typed(~truth_of(inner), "bool")
        inner = number_of(inner, node.value)
        return Typed(-inner.column, inner.kind) if node.value == "-" else inner
    if node.kind == "binary":
        if node.value in ("%in%", "%not_in%"):
            found = _is_in(node, go)
            return Typed(~found if node.value == "%not_in%" else found, "bool")
        if node.value == "~":
            raise ExpressionError("~ stands in case_when() only")
        if node.value == ":":
            raise ExpressionError("a:b stands after %in% only")
        return _binary(node.value, go(node.args[0]), go(node.args[1]))
    if node.kind == "vector":
        raise ExpressionError("c() stands after %in% and in cut() only")
    return _call(node, go)


def _is_in(node: Node, go) -> Column:
    right = node.args[1]
    items = right.args if right.kind == "vector" else [right]
    runs = [i for i in items if i.kind == "binary" and i.value == ":"]
    left = go(node.args[0])
    (own, *values), _ = alike([left, *(go(i) for i in items if i.kind != "null" and i not in runs)], compared=True)
    found = F.coalesce(own.isin(*values), F.lit(False)) if values else F.lit(False)
    for run in runs:  # a:b steps by 1 from a, up or down
        x, a, b = (number_of(t, "a:b").column for t in (left, go(run.args[0]), go(run.args[1])))
        found = found | F.coalesce(x.between(F.least(a, b), F.greatest(a, b)) & ((x - a) % 1 == 0), F.lit(False))
    return found | left.column.isNull() if any(i.kind == "null" for i in items) else found


def _regex(node: Node, options: dict[str, Node]) -> str:
    """A pattern in R's syntax as one of Java's."""
    if node.kind != "string":
        raise ExpressionError("a pattern is a text")
    if _true(options.get("fixed")):
        return re.escape(node.value)
    named = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "space": "Space", "punct": "Punct", "upper": "Upper", "lower": "Lower", "blank": "Blank"}
    out = re.sub(r"\[:(\w+):\]", lambda m: rf"\p{{{named[m[1]]}}}" if m[1] in named else m[0], node.value)
    return ("(?i)" if _true(options.get("ignore.case")) else "") + out


def _true(node: Node | None) -> bool:
    return node is not None and node.kind == "bool" and node.value


def _replacement(node: Node, options: dict[str, Node]) -> str:
    if node.kind != "string":
        raise ExpressionError("a replacement is a text")
    plain = node.value.replace("$", r"\$")
    return plain.replace("\\", "\\\\") if _true(options.get("fixed")) else re.sub(r"\\(\d)", r"$\1", plain)


def _first(x: Column, pattern: str, new: str) -> Column:
    """The first match replaced."""
    at, old = F.regexp_instr(x, F.lit(f"({pattern})")), F.regexp_substr(x, F.lit(pattern))
    changed = F.concat(F.substring(x, F.lit(1), at - 1), F.regexp_replace(old, pattern, new), F.substring(x, at + F.length(old), F.length(x)))
    return F.when(at > 0, changed).otherwise(x)


_DATE_PARTS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def _format(x: Typed, layout: Node | None) -> Column:
    if layout is None:
        return pasted(x)
    if layout.kind != "string":
        raise ExpressionError("format() takes a layout as text")
    parts = re.findall(r"%\w|[^%]+|%", layout.value)
    if bad := [p for p in parts if p[0] == "%" and p not in _DATE_PARTS]:
        raise ExpressionError(f"format() does not know {bad[0]}")
    pattern = "".join(_DATE_PARTS.get(p) or "'" + p.replace("'", "''") + "'" for p in parts)
    return F.date_format(x.column, pattern)


def _sprintf(layout: Node, values: list[Typed]) -> Column:
    if layout.kind != "string":
        raise ExpressionError("sprintf() takes a layout as text")
    marks = [m for m in re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([a-zA-Z%])", layout.value) if m != "%"]
    if len(marks) != len(values) or set(marks) - set("dsfeEgGxXi"):
        raise ExpressionError(f"sprintf() has {len(marks)} places and {len(values)} values, or a place it does not know")
    cast = [pasted(v) if m == "s" else number_of(v, "sprintf()").column.cast("bigint" if m in "dixX" else "double") for m, v in zip(marks, values, strict=True)]
    there = _all_there([c for m, c in zip(marks, cast, strict=True) if m != "s"])
    return F.when(there, F.format_string(re.sub(r"(%[-+ 0#]*\d*)i", r"\1d", layout.value), *cast)) if values else F.lit(layout.value.replace("%%", "%"))


def _numbers(node: Node | None) -> list[float]:
    """The numbers of c(...)."""
    items = node.args if node is not None and node.kind == "vector" else []
    sign = [-1 if i.kind == "unary" and i.value == "-" else 1 for i in items]
    bare = [i.args[0] if i.kind == "unary" else i for i in items]
    if not items or any(b.kind not in ("number", "whole") and b != Node("name", "Inf") for b in bare):
        raise ExpressionError("cut() takes its breaks as c(...) of numbers")
    return [s * (float("inf") if b.kind == "name" else b.value) for s, b in zip(sign, bare, strict=True)]


def _cut(x: Typed, plain: list[Node], named: dict[str, Node]) -> Column:
    """The interval between breaks that holds a number, by its label."""
    breaks = sorted(_numbers(named.get("breaks") or (plain[0] if plain else None)))
    given = named.get("labels") or (plain[1] if len(plain) > 1 else None)
    right = not (r := named.get("right")) or r.value
    lowest = _true(named.get("include.lowest"))
    if len(breaks) < 2:
        raise ExpressionError("cut() takes two breaks at least")
    pairs = list(zip(breaks, breaks[1:], strict=False))
    if given is None:
        shown = ["-Inf" if b == -float("inf") else "Inf" if b == float("inf") else f"{b:.3g}" for b in breaks]
        labels = [f"{'(' if right else '['}{a},{b}{']' if right else ')'}" for a, b in zip(shown, shown[1:], strict=False)]
        if lowest:
            at = 0 if right else -1
            labels[at] = f"[{labels[at][1:-1]}]"
    elif given.kind == "bool" and not given.value:
        labels = list(range(1, len(pairs) + 1))
    else:
        labels = [i.value for i in given.args] if given.kind == "vector" and all(i.kind == "string" for i in given.args) else []
    if len(labels) != len(pairs):
        raise ExpressionError(f"cut() has {len(pairs)} intervals and {len(labels)} labels")
    n = number_of(x, "cut()").column
    out = F.when(F.lit(False), F.lit(labels[0]))
    for i, ((a, b), label) in enumerate(zip(pairs, labels, strict=True)):
        inside = (n > a) & (n <= b) if right else (n >= a) & (n < b)
        if lowest and right and i == 0:
            inside = inside | (n == a)
        if lowest and not right and i == len(pairs) - 1:
            inside = inside | (n == b)
        out = out.when(inside, F.lit(label))
    return out


def _case_when(node: Node, go) -> Typed:
    tests, values, default = [], [], None
    for arg, label in zip(node.args, node.names, strict=True):
        if label == ".default":
            default = go(arg)
            break
        if arg.kind != "binary" or arg.value != "~":
            raise ExpressionError("case_when() takes condition ~ value")
        tests.append(truth_of(go(arg.args[0])))
        values.append(go(arg.args[1]))
    if not tests:
        raise ExpressionError("case_when() takes condition ~ value")
    columns, kind = alike([*values, *([default] if default else [])])
    out = F.when(tests[0], columns[0])
    for test, value in zip(tests[1:], columns[1:], strict=False):
        out = out.when(test, value)
    return Typed(out.otherwise(columns[-1]) if default else out, kind)


def _call(node: Node, go) -> Typed:
    name, args = node.value, node.args
    if name == "case_when":
        return _case_when(node, go)
    if name == "round":
        if not 1 <= len(args) <= 2:
            raise ExpressionError("round() takes one or two arguments")
        x = number_of(go(args[0]), "round()")
        return Typed(F.bround(x.column, _digits(args[1]) if len(args) == 2 else 0), x.kind)
    if name == "log":
        if not 1 <= len(args) <= 2:
            raise ExpressionError("log() takes one or two arguments")
        x, *base = (number_of(go(a), "log()").column for a in args)
        natural = F.when(x > 0, F.ln(x))
        return Typed(_divide(natural, F.ln(base[0])) if base else natural, "double")
    if name == "paste":
        sep = [text_of(go(a)) for a, n in zip(args, node.names, strict=True) if n == "sep"]
        rest = [pasted(go(a)) for a, n in zip(args, node.names, strict=True) if n is None]
        between = sep[0] if sep else F.lit(" ")
        return Typed(F.concat(*[x for i, r in enumerate(rest) for x in ([between, r] if i else [r])]), "text")
    named = {n: a for a, n in zip(args, node.names or [None] * len(args), strict=True) if n}
    plain = [a for a, n in zip(args, node.names or [None] * len(args), strict=True) if not n]
    if name == "cut" and plain:
        labelled = named.get("labels") is None or named["labels"].kind != "bool"
        return Typed(_cut(go(plain[0]), plain[1:], named), "text" if labelled else "int")
    if name == "difftime" and len(plain) == 2 and (named.get("units") or Node("string", "days")) == Node("string", "days"):
        return Typed(F.datediff(*(_date(go(a)) for a in plain)), "int")
    if name in ("grepl", "str_detect") and len(plain) == 2:
        pattern, x = plain if name == "grepl" else plain[::-1]
        found = text_of(go(x)).rlike(_regex(pattern, named))
        return Typed(F.coalesce(found, F.lit(False)) if name == "grepl" else found, "bool")
    if name in ("gsub", "sub", "str_replace_all", "str_replace") and len(plain) == 3:
        pattern, new, x = plain if name in ("gsub", "sub") else (plain[1], plain[2], plain[0])
        every = F.regexp_replace if name in ("gsub", "str_replace_all") else _first
        return Typed(every(text_of(go(x)), _regex(pattern, named), _replacement(new, named)), "text")
    if name == "sprintf" and plain:
        return Typed(_sprintf(plain[0], [go(a) for a in plain[1:]]), "text")
    if name == "format" and 1 <= len(args) <= 2:
        return Typed(_format(go(args[0]), args[1] if len(args) == 2 else None), "text")
    if name not in _SIMPLE:
        raise ExpressionError(f"unknown function {name}()")
    least, most, fn = _SIMPLE[name]
    if not least <= len(args) <= most:
        raise ExpressionError(f"{name}() takes {least} to {most} arguments")
    return fn(*(go(a) for a in args))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(names: Iterable[str] | Mapping[str, str]) -> dict[str, tuple[str, str]]:
    """Lower-case names to names and kinds, from names alone or with their types."""
    return {n.lower(): (n, kind_of(names[n]) if isinstance(names, Mapping) else "any") for n in names}


def to_column(text: str, names: Iterable[str] | Mapping[str, str]) -> Column:
    """The expression over a table with columns ``names``, or, better, with types of columns by name."""
    return compile_node(RParser(text).parse(), columns_of(names)).column


def columns_read(text: str) -> set[str]:
    return {n.lower() for n in names_in(RParser(text).parse())}
