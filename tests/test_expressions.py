import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.catalog import QUERIES
from tabloom.functions import rexpr, tsql
from tabloom.functions.parse import ExpressionError


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, 2.5, "ab", "2020-02-29", True, -7), (2, None, None, None, None, None), (3, 0.0, "C d", "2021-12-31", False, 7)],
        "id int, x double, `my text` string, day string, flag boolean, k int",
    )


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ifelse(x > 1, 'hi', 'lo')", ["hi", None, "lo"]),
        ("ifelse(is.na(x), 0, x) + 1", [3.5, 1.0, 1.0]),
        ("x %in% c(2.5, 9)", [True, False, False]),
        ("x %in% c(2.5, NA)", [True, True, False]),
        ("!(x %in% c(2.5)) & id != 2", [False, False, True]),
        ("k %% 3", [2, None, 1]),
        ("k %/% 2", [-4, None, 3]),
        ("-2 ^ 2 + id", [-3.0, -2.0, -1.0]),
        ("2 * id == 4 | flag", [True, True, False]),
        ("1 / x", [0.4, None, None]),
        ("paste0(`my text`, id)", ["ab1", "NA2", "C d3"]),
        ("paste('a', id, sep = '-')", ["a-1", "a-2", "a-3"]),
        ("nchar(`my text`)", [2, None, 3]),
        ("substr(toupper(`my text`), 1, 2)", ["AB", None, "C "]),
        ("case_when(id == 1 ~ 'one', x == 0 ~ 'zero', TRUE ~ 'other')", ["one", "other", "zero"]),
        ("dplyr::coalesce(x, -1)", [2.5, -1.0, 0.0]),
        ("round(x)", [2.0, None, 0.0]),
        ("pmax(x, 1)", [2.5, None, 1.0]),
        ("between(id, 2, 3)", [False, True, True]),
        ("as.numeric(day)", [None, None, None]),
        ("log(exp(1))", [1.0, 1.0, 1.0]),
        ("log(8, base = 2)", [3.0, 3.0, 3.0]),
        ("sqrt(k)", [None, None, pytest.approx(2.6457513)]),
        ("as.integer(2.9) + ID", [3, 4, 5]),
        ("NA_character_", [None, None, None]),
    ],
)
def test_r_expressions(df, text, want):
    assert [r[0] for r in df.orderBy("id").select(rexpr.to_column(text, dict(df.dtypes)).alias("v")).collect()] == want


@pytest.mark.parametrize("text", ["system('x')", "x +", "y", "c(1, 2)", "x ~ 1", "x; 1", "ifelse(x)", "a$b", "'open", "round(x, y)", "case_when(x)"])
def test_r_expressions_that_are_refused(df, text):
    with pytest.raises(ExpressionError):
        rexpr.to_column(text, df.columns)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IIF([x] > 1, [id], NULL)", [1, None, None]),
        ("CASE WHEN x IS NULL THEN 'none' WHEN x = 0 THEN 'zero' ELSE 'some' END", ["some", "none", "zero"]),
        ("CASE id WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", ["a", "b", None]),
        ("DATEADD(YEAR, -1, [day])", [datetime.date(2019, 2, 28), None, datetime.date(2020, 12, 31)]),
        ("DATEADD(DAY, 1, day)", [datetime.date(2020, 3, 1), None, datetime.date(2022, 1, 1)]),
        ("DATE(day, '-1 years', '+1 day')", [datetime.date(2019, 3, 1), None, datetime.date(2021, 1, 1)]),
        ("DATEDIFF(MONTH, '2020-01-31', day)", [1, None, 23]),
        ("DATEDIFF(DAY, '2020-02-28', day)", [1, None, 672]),
        ("JULIANDAY(day) - JULIANDAY('2020-02-28')", [1.0, None, 672.0]),
        ("dmt.[id] IN (1, 3) AND NOT [x] BETWEEN 1 AND 3", [False, False, True]),
        ("id NOT IN (1)", [False, True, True]),
        ("[my text] LIKE 'a%'", [True, None, False]),
        ("CAST(x AS INT) + 1", [3, None, 1]),
        ("CONVERT(VARCHAR(5), id)", ["1", "2", "3"]),
        ("LEN('ab  ') + ISNULL(k, 0)", [-5, 2, 9]),
        ("1.0 * id / 0", [None, None, None]),
        ("CONCAT([my text], '!', N'it''s')", ["ab!it's", "!it's", "C d!it's"]),
        ("LEFT([my text], 1)", ["a", None, "C"]),
        ("YEAR(day) * 100 + MONTH(day)", [202002, None, 202112]),
        ("x IS NOT NULL OR id = 2", [True, True, True]),
    ],
)
def test_sql_expressions(df, text, want):
    got = df.orderBy("id").select(tsql.to_column(text, lambda n: F.col(rexpr.quote(n))).alias("v")).collect()
    assert [r[0] for r in got] == want


@pytest.mark.parametrize("text", ["EXEC x", "DROP", "x +", "f(x)", "DATEADD(NANOSECOND, 1, day)", "'a", "CASE x END", "x; y"])
def test_sql_expressions_that_are_refused(df, text):
    def known(name):
        if name not in df.columns:
            raise ExpressionError(name)
        return F.col(name)

    with pytest.raises(ExpressionError):
        tsql.to_column(text, known)


def test_columns_read():
    assert rexpr.columns_read("ifelse(A > b, `c d`, 'e')") == {"a", "b", "c d"}
    assert tsql.columns_read("DATEADD(YEAR, 1, [a]) > CASE WHEN b = 1 THEN c ELSE d END") == {"a", "b", "c", "d"}


@pytest.mark.parametrize("text", ["1:3", "sprintf('%d')", "sprintf('%d', 1, 2)", "gsub(a, 'x', b)", "format(a, '%Q')", "format(a, b)"])
def test_r_expressions_that_are_refused(text):
    with pytest.raises(ValueError):
        rexpr.to_column(text, ["a", "b"])


# coercions


@pytest.fixture(scope="module")
def kinds(spark):
    day = datetime.date(2024, 2, 29)
    rows = [(1, 5, 5.0, True, "5", day, datetime.datetime(2024, 2, 29, 13, 5, 9)), (2, 100000, 1e7, False, "b", None, None), (3, -12, -0.00001234, None, None, datetime.date(2023, 12, 31), datetime.datetime(2023, 12, 31, 0, 0))]
    return spark.createDataFrame(rows, "id int, n int, x double, yes boolean, t string, d date, at timestamp")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("as.character(x)", ["5", "1e+07", "-1.234e-05"]),
        ("paste0(n)", ["5", "100000", "-12"]),
        ("paste0(1e5, '/', 123456, '/', 0.1, '/', 1e-4, '/', 100000L)", ["1e+05/123456/0.1/1e-04/100000"] * 3),
        ("paste0(1/3, '/', 2/3*1e6, '/', 1e15, '/', 123456789012)", ["0.333333333333333/666666.666666667/1e+15/123456789012"] * 3),
        ("paste(yes, is.na(t))", ["TRUE FALSE", "FALSE FALSE", "NA TRUE"]),
        ("nchar(x)", [1, 5, 10]),
        ("nchar(5)", [1, 1, 1]),
        ("sprintf('%s|%s|%d', x, yes, n)", ["5|TRUE|5", "1e+07|FALSE|100000", "-1.234e-05|NA|-12"]),
        ("t == 5", [True, False, None]),
        ("t == n", [True, False, None]),
        ("t %in% c(5, 'b')", [True, True, False]),
        ("n %in% c('5', '-12')", [True, False, True]),
        ("ifelse(n > 0, 'a', 1)", ["a", "a", "1"]),
        ("ifelse(n > 0, n, 'none')", ["5", "100000", "none"]),
        ("case_when(n == 5 ~ 'five', TRUE ~ x)", ["five", "1e+07", "-1.234e-05"]),
        ("coalesce(t, n)", ["5", "b", "-12"]),
        ("yes + 1", [2, 1, None]),
        ("yes == 1", [True, False, None]),
        ("(n > 0) + (x > 1)", [2, 2, 0]),
        ("ifelse(n, 'some', 'none')", ["some", "some", "some"]),
        ("!n", [False, False, False]),
        ("yes & n", [True, False, None]),
        ("d == '2024-02-29'", [True, None, False]),
        ("d > as.Date('2024-01-01')", [True, None, False]),
        ("d + 1", [datetime.date(2024, 3, 1), None, datetime.date(2024, 1, 1)]),
        ("d - as.Date('2024-02-28')", [1, None, -59]),
        ("paste0(d)", ["2024-02-29", "NA", "2023-12-31"]),
        ("as.numeric(yes)", [1.0, 0.0, None]),
        ("as.logical('yes')", [None, None, None]),
        ("as.logical('T') & as.logical(n)", [True, True, True]),
        ("toupper(yes)", ["TRUE", "FALSE", None]),
        ("cut(n, c(-Inf, 0, 5, Inf))", ["(0,5]", "(5,Inf]", "(-Inf,0]"]),
        ("cut(n, c(0, 5, 1e6), labels = c('low', 'high'), right = FALSE)", ["high", "high", None]),
        ("cut(n, breaks = c(5, 10, 20), labels = FALSE, include.lowest = TRUE)", [1, None, None]),
        ("trunc(-1.5) + log10(100)", [1.0, 1.0, 1.0]),
        ("weekdays(d)", ["Thursday", None, "Sunday"]),
        ("difftime(d, '2024-02-01', units = 'days')", [28, None, -32]),
        ("pmax(n, x)", [5.0, 1e7, -0.00001234]),
    ],
)
def test_r_coercions(kinds, text, want):
    assert [r[0] for r in kinds.orderBy("id").select(rexpr.to_column(text, dict(kinds.dtypes)).alias("v")).collect()] == want


@pytest.mark.parametrize("text", ["t + 1", "-t", "sqrt(t)", "t & yes & d", "d + d", "sum(n)", "cut(n)", "cut(n, c(1, 2), labels = c('a', 'b'))", "sprintf('%d', t)"])
def test_r_kinds_that_do_not_fit(kinds, text):
    with pytest.raises(ExpressionError):
        rexpr.to_column(text, dict(kinds.dtypes))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[t] + NULL", [None, None, None]),
        ("t + '!'", ["5!", "b!", None]),
        ("n / 2", [2, 50000, -6]),
        ("yes + 1", [2, 1, None]),
        ("IIF(yes = 1, 'y', 'n')", ["y", "n", "n"]),
        ("CASE WHEN yes = 1 THEN yes ELSE 7 END", [1, 7, 7]),
        ("d + 1", [datetime.date(2024, 3, 1), None, datetime.date(2024, 1, 1)]),
        ("CAST(x AS VARCHAR(20)) + '/' + CAST(n AS VARCHAR(2))", ["5/5", "1e+07/10", "-1.234e-05/-1"]),
        ("CONCAT(x, yes, n)", ["515", "1e+070100000", "-1.234e-05-12"]),
        ("DATEPART(YEAR, d) * 1000 + DATEPART(DAYOFYEAR, d)", [2024060, None, 2023365]),
        ("DATEPART(WEEKDAY, d) + 10 * DATEPART(QUARTER, d)", [15, None, 41]),
        ("DATEPART(WEEK, d)", [9, None, 53]),
        ("DATEPART(ISO_WEEK, d)", [9, None, 52]),
        ("DATEPART(HOUR, at) * 60 + DATEPART(MINUTE, at)", [785, None, 0]),
        ("DATENAME(MONTH, d) + ' ' + DATENAME(WEEKDAY, d) + ' ' + DATENAME(DAY, d)", ["February Thursday 29", None, "December Sunday 31"]),
        ("CONVERT(VARCHAR(10), at, 103)", ["29/02/2024", None, "31/12/2023"]),
        ("CONVERT(VARCHAR(16), at, 120)", ["2024-02-29 13:05", None, "2023-12-31 00:00"]),
        ("CONVERT(CHAR(8), d, 112) + CONVERT(VARCHAR, d, 107)", ["20240229Feb 29, 2024", None, "20231231Dec 31, 2023"]),
        ("CONVERT(DATE, '31/12/2020', 103)", [datetime.date(2020, 12, 31)] * 3),
        ("LOG(EXP(2)) + LOG(8, 2) + LOG10(100)", [pytest.approx(7.0)] * 3),
        ("FORMAT(d, 'dd/MM/yyyy')", ["29/02/2024", None, "31/12/2023"]),
        ("FORMAT(x, 'N2') + FORMAT(n, '0000')", ["5.000005", "10,000,000.00100000", "-0.00-012"]),
        ("REPLICATE('ab', 2) + SPACE(1) + REPLICATE(n, 1)", ["abab 5", "abab 100000", "abab -12"]),
        ("PATINDEX('%[0-9]%', CONCAT('a', n))", [2, 2, 3]),
        ("PATINDEX('a%', 'ab')", [1, 1, 1]),
        ("CONCAT('x', n) LIKE 'x[^-]%'", [True, True, False]),
        ("CHOOSE(id, 'one', 'two')", ["one", "two", None]),
        ("ISDATE('2024-02-30') + ISDATE(d) * 10 + ISNUMERIC(t) * 100", [110, 0, 10]),
        ("CONCAT_WS('-', n, t, yes)", ["5-5-1", "100000-b-0", "-12"]),
        ("LEN(n) + ASCII('A')", [66, 71, 68]),
        ("EOMONTH(d, 1)", [datetime.date(2024, 3, 31), None, datetime.date(2024, 1, 31)]),
        ("GREATEST(n, 7) - LEAST(n, 7)", [2, 99993, 19]),
        ("n % 7 + ROUND(x, 0)", [10.0, pytest.approx(1e7 + 5), -5.0]),
    ],
)
def test_sql_coercions(kinds, text, want):
    kind = lambda c: kinds.select(c).schema[0].dataType.simpleString()
    got = kinds.orderBy("id").select(tsql.to_column(text, lambda n: F.col(rexpr.quote(n)), kind).alias("v")).collect()
    assert [r[0] for r in got] == want


@pytest.mark.parametrize("text", ["CONVERT(VARCHAR(9), d, 999)", "DATEPART(EON, d)", "FORMAT(n, 'zzz')", "PATINDEX(t, t)", "CHOOSE(1)", "REPLICATE('a')"])
def test_sql_calls_that_are_refused(kinds, text):
    with pytest.raises(ExpressionError):
        tsql.to_column(text, F.col, lambda c: kinds.select(c).schema[0].dataType.simpleString())


def test_decimals_as_text(spark):
    df = spark.range(1).selectExpr("cast(5 as decimal(10,2)) AS d", "true AS yes")
    kind = lambda c: df.select(c).schema[0].dataType.simpleString()
    assert df.select(tsql.to_column("CONCAT(d, '/', CAST(d + 1 AS VARCHAR(4)), '/', d + yes)", F.col, kind)).first()[0] == "5.00/6.00/6.00"
    assert df.select(rexpr.to_column("paste0(d, '/', d / 2, '/', d + 1, '/', d == 5, '/', ifelse(d, 'some', 0))", dict(df.dtypes))).first()[0] == "5/2.5/6/TRUE/some"


def test_halves_of_large_keys_are_written_in_full(spark, tmp_path):
    """R writes the double 100000 as 1e+05; the query's halves are whole numbers and a rest, as in its SQL."""
    rows = [(i, key, "O", 1.5, datetime.datetime(1996, 7, 1), "1-URGENT") for i, key in enumerate((7, 50, 200_000, 200_001, 400_000, 2_000_000))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    said = [r.said for r in QUERIES["expr_r_coercions"](spark, str(tmp_path)).orderBy("o_orderkey").collect()]
    assert said == ["0/3.5/FALSE", "1/25/FALSE", "2/100000/TRUE", "3/100000.5/TRUE", "4/200000/TRUE", "5/1000000/TRUE"]
