"""Statements of SQL Server's kind, run on Spark in a session of their own.

A script's own tables, ``#name``, are frames that live as long as its session:
what is selected or inserted into one is stored, so it stays as it was when the
statement ran. Other statements are given to Spark after a few rewrites: bracketed
names, names with a database before them, TOP, SELECT INTO, types, and functions
that have another name. Statements of Spark SQL pass as they are.

Not known: variables, loops, procedures, and ``+`` between texts outside of
control files (use CONCAT).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.rexpr import quote
from tabloom.operators.types import TYPES, spark_type
from tabloom.sources.names import sql2id
from tabloom.sources.work import drop, stored

_TOKEN = re.compile(r"(?P<space>\s+)|(?P<string>N?'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\")|(?P<ticked>`[^`]*`)|(?P<bracket>\[[^\]]*\])|(?P<temp>##?\w+)|(?P<word>@{0,2}[^\W\d][\w$@]*)|(?P<number>\d+(?:\.\d+)?)|(?P<op>.)", re.S)
_STARTERS = {"SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE", "USE", "SET", "PRINT", "IF", "EXEC", "EXECUTE", "DECLARE", "MERGE"}
#: Functions that Spark has under another name.
_FUNCTIONS = {"GETDATE": "current_timestamp", "SYSDATETIME": "current_timestamp", "IIF": "if", "CEILING": "ceil", "REPLICATE": "repeat", "SQUARE": "pow2", "STDEV": "stddev_samp", "VAR": "var_samp", "COUNT_BIG": "count"}


@dataclass
class Token:
    kind: str
    text: str
    depth: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(code: str) -> list[Token]:
    out, depth = [], 0
    for m in _TOKEN.finditer(code):
        kind, text = m.lastgroup, m[0]
        if kind == "bracket":
            before = out[-1].text[-1] if out else " "
            if re.fullmatch(r"\[\s*[-\d]*\s*\]", text) or before.isalnum() or before in "_)`]'":
                kind = "op"  # a place in an array
        depth -= text == ")"
        out.append(Token(kind, text, depth))
        depth += text == "("
    return out


def statements(code: str) -> list[list[Token]]:
    """A batch's statements: each starts a line, where nothing before it is unfinished."""
    out: list[list[Token]] = []
    current: list[Token] = []
    begins, last, fresh = "", "", True
    taken: set[str] = set()

    def unfinished(word: str) -> bool:
        if last in ("UNION", "ALL", "EXCEPT", "INTERSECT", "AS", "EXISTS", "BEGIN"):
            return True
        if word == "SET":
            return begins == "UPDATE" and "SET" not in taken
        if word in ("SELECT", "WITH"):
            return begins in ("INSERT", "WITH") and not taken & {"SELECT", "VALUES"}
        return begins == "IF" and not taken & {"DROP", "TRUNCATE"} or begins == "WITH" and not taken & {"SELECT", "INSERT", "UPDATE", "DELETE"}

    for t in tokens(code):
        if t.word in _STARTERS and not t.depth and fresh and not unfinished(t.word):
            if any(x.kind != "space" for x in current):
                out.append(current)
            current, begins, taken = [], t.word, set()
        elif t.word and not t.depth:
            taken.add(t.word)
        current.append(t)
        if t.kind == "space":
            fresh = fresh or "\n" in t.text
        else:
            fresh, last = False, t.word or t.text
            fresh = t.text == ";"
    if any(x.kind != "space" and x.text != ";" for x in current):
        out.append(current)
    return out


def _plain(ts: list[Token]) -> list[Token]:
    return [t for t in ts if t.kind != "space" and t.text != ";"]


def _text(ts: list[Token]) -> str:
    return "".join(t.text for t in ts).strip().rstrip(";")


def temp_view(name: str) -> str:
    """The view that stands for ``#name``."""
    return f"temp__{name.lstrip('#').lower()}"


def _name_at(ts: list[Token], at: int) -> tuple[str, int]:
    """The dotted name that starts at a token (with gaps taken out), and where it ends."""
    parts = []
    while at < len(ts) and ts[at].kind in ("word", "bracket", "ticked", "temp", "string"):
        parts.append(ts[at].text)
        at += 1
        while at < len(ts) and ts[at].text == ".":  # a..b leaves a schema out
            at += 1
            if ts[at].text != "." and ts[at].kind in ("word", "bracket", "ticked", "temp"):
                break
        else:
            break
    return ".".join(parts), at


class SqlScript:
    """Runs statements one after another; tables of its own go with ``close``."""

    def __init__(self, spark: SparkSession):
        self.session = spark.newSession()
        self._stored: list[str] = []

    # names

    def _find(self, name: str) -> str:
        """A table's name in this session: the whole, else without leading parts; a script's own by its view."""
        parts = sql2id(name.replace("`", ""))
        if parts[-1].startswith("#"):
            return quote(temp_view(parts[-1]))
        for i in range(len(parts)):
            at = ".".join(map(quote, parts[i:]))
            try:
                if len(parts) - i <= 3 and self.session.catalog.tableExists(at):
                    return at
            except Exception:  # a catalog that the session does not have
                continue
        # no such table: where it is to be made
        for i in range(len(parts) - 1):
            try:
                if self.session.catalog.databaseExists(".".join(map(quote, parts[i:-1]))):
                    return ".".join(map(quote, parts[i:]))
            except Exception:
                continue
        return quote(parts[-1])

    def rewrite(self, ts: list[Token]) -> str:
        """One query or statement as Spark SQL."""
        ts = self._tables(self._top(ts))
        out: list[str] = []
        for i, t in enumerate(ts):
            after = next((x for x in ts[i + 1 :] if x.kind != "space"), None)
            called = after is not None and after.text == "("
            if t.kind == "bracket":
                out.append(quote(t.text[1:-1]))
            elif t.kind == "temp":
                out.append(quote(temp_view(t.text)))
            elif t.kind == "string" and t.text.startswith("N'"):
                out.append(t.text[1:])
            elif called and t.word in _FUNCTIONS and t.word != "SQUARE":
                out.append(_FUNCTIONS[t.word])
            elif called and t.word == "ISNULL" and self._arguments(ts, i) == 2:
                out.append("coalesce")
            elif called and t.word == "LEN":
                out.append("length")
            elif t.word in TYPES and (prev := next((x for x in reversed(ts[:i]) if x.kind != "space"), None)) and prev.word == "AS" and t.depth and not called:
                out.append(spark_type(t.text))
            elif t.word in TYPES and called and (prev := next((x for x in reversed(ts[:i]) if x.kind != "space"), None)) and prev.word == "AS" and t.word.startswith("N"):
                out.append(t.text[1:])  # NVARCHAR(n)
            else:
                out.append(t.text)
        return "".join(out).strip().rstrip(";")

    @staticmethod
    def _arguments(ts: list[Token], at: int) -> int:
        depth, n = ts[at].depth + 1, 1
        for t in ts[at + 1 :]:
            if t.text == ")" and t.depth == depth - 1:
                return n
            n += t.text == "," and t.depth == depth
        return n

    @staticmethod
    def _top(ts: list[Token]) -> list[Token]:
        """SELECT TOP n ... becomes SELECT ... LIMIT n, at the end of its own select."""
        ts = list(ts)
        at = 0
        while at < len(ts):
            if ts[at].word == "TOP":
                before = next((x for x in reversed(ts[:at]) if x.kind != "space"), None)
                rest = [i for i in range(at + 1, len(ts)) if ts[i].kind != "space"]
                if before is not None and before.word in ("SELECT", "DISTINCT") and rest and (ts[rest[0]].kind == "number" or ts[rest[0]].text == "("):
                    bracketed = ts[rest[0]].text == "("
                    n, last = (ts[rest[1]].text, rest[2]) if bracketed else (ts[rest[0]].text, rest[0])
                    depth = ts[at].depth
                    begin = next(i for i in range(at, -1, -1) if ts[i].word == "SELECT")
                    sets = ("UNION", "EXCEPT", "INTERSECT")
                    joined = next((x.word for x in reversed(ts[:begin]) if x.kind != "space"), "") in (*sets, "ALL")
                    stops = (*sets, "ORDER") if joined else sets
                    end = next((i for i in range(last + 1, len(ts)) if (ts[i].text == ")" and ts[i].depth == depth - 1) or (ts[i].depth == depth and ts[i].word in stops) or ts[i].text == ";"), len(ts))
                    joined = joined or (end < len(ts) and ts[end].word in sets)
                    ts[end:end] = [Token("space", " ", depth), Token("word", f"LIMIT {n}", depth), *([Token("op", ")", depth)] if joined else []), Token("space", " ", depth)]
                    if joined:  # one select of several has a limit of its own in brackets only
                        ts.insert(begin, Token("op", "(", depth))
                        at, last = at + 1, last + 1
                    del ts[at : last + 1]
                    continue
            at += 1
        return ts

    def _tables(self, ts: list[Token]) -> list[Token]:
        """Names after FROM, JOIN and INTO as this session has them; hints go."""
        out, at = [], 0
        while at < len(ts):
            t = ts[at]
            if t.word == "WITH" and len(p := _plain(ts[at : at + 8])) > 3 and p[1].text == "(" and p[2].word in ("NOLOCK", "TABLOCK", "READUNCOMMITTED"):
                at = next(i for i in range(at, len(ts)) if ts[i].text == ")") + 1
                continue
            out.append(t)
            at += 1
            if t.word in ("FROM", "JOIN", "TABLE", "INTO", "UPDATE"):
                while at < len(ts) and ts[at].kind == "space":
                    out.append(ts[at])
                    at += 1
                name, end = _name_at(ts, at)
                if "." in name and end < len(ts) + 1 and not (end < len(ts) and ts[end].text == "("):
                    out.append(Token("ticked", self._find(name), t.depth))
                    at = end
        return out

    # statements

    def run(self, code: str) -> DataFrame | None:
        """All statements of a batch; the frame of the last query, which has run."""
        out = None
        for s in statements(code):
            out = self._one(s)
        return out

    def texts(self, code: str) -> list[str]:
        """What Spark is to parse of a batch."""
        out = []
        for s in statements(code):
            p = _plain(s)
            first = p[0].word
            if first in ("SELECT", "WITH"):
                out.append(self.rewrite(_without_into(s)[0]))
            elif first == "INSERT" and (rest := _body_of_insert(s)) and _plain(rest)[0].word != "VALUES":
                out.append(self.rewrite(rest))
            elif not self._own(p) and first not in ("USE", "PRINT", "IF", "INSERT") and not _is_switch(p):
                out.append(self.rewrite(s))
        return out

    @staticmethod
    def _own(p: list[Token]) -> bool:
        """Whether a statement makes or changes a table of the script's own, or is one that Spark words otherwise."""
        words = [t.word for t in p[:3]]
        return words[0] in ("CREATE", "DROP", "ALTER", "TRUNCATE", "UPDATE", "DELETE") and (any(t.kind == "temp" for t in p) or words[:2] == ["CREATE", "TABLE"] and not {"USING", "AS"} & {t.word for t in p})

    def _one(self, s: list[Token]) -> DataFrame | None:
        p = _plain(s)
        first, second = p[0].word, p[1].word if len(p) > 1 else ""
        if first == "USE" or _is_switch(p):
            return None
        if first == "PRINT":
            print(_text(s)[5:].strip().strip("'"))
            return None
        if first == "IF":
            return self._if(s, p)
        if first in ("SELECT", "WITH"):
            query, into = _without_into(s)
            return self._into(into, self.session.sql(self.rewrite(query))) if into else self._ran(self.session.sql(self.rewrite(query)))
        if first == "INSERT":
            return self._insert(s, p)
        if [first, second] == ["DROP", "TABLE"]:
            return self._drop(p)
        if not self._own(p):
            return self._ran(self.session.sql(self.rewrite(s)))
        name, at = _name_at(p, 2 if second in ("TABLE", "FROM") else 1)
        if first == "CREATE":
            return self._create(name, p[at:])
        if first == "TRUNCATE":
            return self._keep(name, self._frame(name).where("false"))
        if first == "ALTER":
            return self._alter(name, p[at:])
        return self._change(first, name, s)

    def _ran(self, df: DataFrame) -> DataFrame:
        """Run now, with no row for the driver; commands have run already."""
        df.write.format("noop").mode("overwrite").save()
        return df

    def _frame(self, name: str) -> DataFrame:
        return self.session.table(self._find(name))

    def _keep(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(temp_view(sql2id(name)[-1]))

    def _store(self, df: DataFrame) -> DataFrame:
        held, path = stored(df, "script", with_path=True)
        self._stored.append(path)
        return held

    def _into(self, name: str, df: DataFrame) -> None:
        if "#" in name:
            self._keep(name, self._store(df))
        else:
            df.write.saveAsTable(self._find(name))

    def _create(self, name: str, rest: list[Token]) -> None:
        columns = [(quote(n), spark_type(t)) for n, t in _columns(rest)]
        ddl = ", ".join(f"{n} {t}" for n, t in columns)
        if "#" in name:
            self._keep(name, self.session.createDataFrame([], ddl))
        else:
            self.session.sql(f"CREATE TABLE {self._find(name)} ({ddl}) USING parquet")

    def _insert(self, s: list[Token], p: list[Token]) -> None:
        at = 2 if p[1].word == "INTO" else 1
        name, at = _name_at(p, at)
        body = _body_of_insert(s)
        target = self._frame(name)
        columns = target.columns
        if p[at].text == "(":
            end = next(i for i in range(at, len(p)) if p[i].text == ")")
            columns = [sql2id(t.text.strip("`"))[0] for t in p[at + 1 : end] if t.text != ","]
        made = self.session.sql(self.rewrite(body))
        if len(made.columns) != len(columns):
            raise ValueError(f"{len(columns)} columns and {len(made.columns)} values")
        by = {c.lower(): made.columns[i] for i, c in enumerate(columns)}
        made = made.toDF(*(f"v{i}" for i in range(len(columns))))
        place = {c.lower(): f"v{i}" for i, c in enumerate(columns)}
        kinds = dict(target.dtypes)
        row = made.select(*((F.col(place[c.lower()]) if c.lower() in by else F.lit(None)).cast(kinds[c]).alias(c) for c in target.columns))
        if "#" in name:
            self._keep(name, target.unionByName(self._store(row)))
        else:
            row.write.insertInto(self._find(name).replace("`", ""))

    def _drop(self, p: list[Token]) -> None:
        maybe = [t.word for t in p[2:4]] == ["IF", "EXISTS"]
        for name in _text([Token(t.kind, t.text, 0) for t in p[4 if maybe else 2 :]]).split(","):
            own = sql2id(name.strip())[-1]
            if own.startswith("#"):
                if not self.session.catalog.dropTempView(temp_view(own)) and not maybe:
                    raise ValueError(f"no table {own}")
            else:
                self.session.sql(f"DROP TABLE {'IF EXISTS ' if maybe else ''}{self._find(name.strip())}")

    def _if(self, s: list[Token], p: list[Token]) -> None:
        """IF OBJECT_ID('...') IS NOT NULL DROP TABLE ..., and no other."""
        at = next((i for i, t in enumerate(p) if t.word == "DROP"), None)
        if p[1].word != "OBJECT_ID" or at is None:
            raise ValueError("IF is known with OBJECT_ID and DROP TABLE only")
        self._drop([*p[at : at + 2], Token("word", "IF", 0), Token("word", "EXISTS", 0), *p[at + 2 :]])

    def _alter(self, name: str, rest: list[Token]) -> None:
        df = self._frame(name)
        if [t.word for t in rest[:2]] == ["DROP", "COLUMN"]:
            return self._keep(name, df.drop(*(t.text.strip("[]`") for t in rest[2:] if t.text != ",")))
        if rest[0].word != "ADD":
            raise ValueError("ALTER TABLE is known with ADD and DROP COLUMN only")
        for n, t in _columns([Token("op", "(", 0), *rest[1:], Token("op", ")", 0)]):
            df = df.withColumn(n, F.lit(None).cast(spark_type(t)))
        return self._keep(name, df)

    def _change(self, what: str, name: str, s: list[Token]) -> None:
        """UPDATE ... SET ... WHERE and DELETE FROM ... WHERE of a script's own table."""
        df = self._frame(name)
        words = [(i, t.word) for i, t in enumerate(s) if not t.depth]
        where = next((i for i, w in words if w == "WHERE"), len(s))
        test = F.expr(self.rewrite(s[where + 1 :])) if where < len(s) else F.lit(True)
        hit = F.coalesce(test, F.lit(False))
        if what == "DELETE":
            return self._keep(name, self._store(df.where(~hit)))
        begin = next(i for i, w in words if w == "SET")
        if any(w == "FROM" for _, w in words):
            raise ValueError("UPDATE with FROM is not known")
        new: dict[str, Column] = {}
        for part in _split(s[begin + 1 : where]):
            left = next(i for i, t in enumerate(part) if t.text == "=")
            new[_text(part[:left]).strip("[]`").lower()] = F.expr(self.rewrite(part[left + 1 :]))
        kinds = dict(df.dtypes)
        changed = [F.when(hit, new[c.lower()].cast(kinds[c])).otherwise(F.col(quote(c))).alias(c) if c.lower() in new else F.col(quote(c)) for c in df.columns]
        return self._keep(name, self._store(df.select(*changed)))

    def close(self) -> None:
        """The script's own tables go."""
        for path in self._stored:
            drop(self.session, path)
        self._stored.clear()


def _is_switch(p: list[Token]) -> bool:
    """SET NOCOUNT ON and its kin."""
    return p[0].word == "SET" and p[-1].word in ("ON", "OFF")


def _split(ts: list[Token]) -> list[list[Token]]:
    """At commas outside of brackets."""
    out: list[list[Token]] = [[]]
    least = min((t.depth for t in ts), default=0)
    for t in ts:
        if t.text == "," and t.depth == least:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _columns(rest: list[Token]) -> list[tuple[str, str]]:
    """(name type, ...): names and types; NULL, NOT NULL, keys and defaults are left out."""
    inner = rest[1:-1] if rest and rest[-1].text == ")" else rest[1:]
    out = []
    for part in _split(inner):
        part = _plain(part)
        if part and part[0].word not in ("PRIMARY", "CONSTRAINT", "UNIQUE", "INDEX", "CHECK"):
            out.append((part[0].text.strip("[]`"), " ".join(t.text for t in part[1:])))
    return out


def _without_into(s: list[Token]) -> tuple[list[Token], str | None]:
    """SELECT ... INTO name FROM ...: the query, and the name."""
    at = next((i for i, t in enumerate(s) if t.word == "INTO" and not t.depth), None)
    if at is None:
        return s, None
    end = at + 1
    while s[end].kind == "space":
        end += 1
    name, after = _name_at(s, end)
    return [*s[:at], *s[after:]], name


def _body_of_insert(s: list[Token]) -> list[Token]:
    at = next((i for i, t in enumerate(s) if not t.depth and t.word in ("SELECT", "VALUES", "WITH")), None)
    if at is None:
        raise ValueError("INSERT takes VALUES or a SELECT")
    return s[at:]


__all__ = ["SqlScript", "statements", "temp_view", "tokens"]
