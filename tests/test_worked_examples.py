"""Worked examples from files to files, with results worked out by hand: assembly, summary and confidential one after another."""

from __future__ import annotations

import csv

import pytest

from tabloom.operators.assembly import run_assembly
from tabloom.operators.confidential import run_confidential
from tabloom.operators.report import SUCCESS
from tabloom.operators.summary import run_summary
from tabloom.sources.controlfile import load_control_file
from tabloom.sources.tables import load_csv

FILES = {
    "people.csv": """uid,start,stop
1,2020-01-01,2020-12-31
1,2021-01-01,2021-12-31
2,2020-01-01,2020-12-31
3,2021-01-01,2021-12-31
""",
    "benefits.csv": """id,from,to,amount,kind
1,2019-12-01,2020-01-31,62,sickness
1,2020-06-01,2021-05-31,365,training
1,2020-06-15,2020-06-24,100,sickness
2,2021-03-01,2021-03-10,50,sickness
3,2021-02-01,2021-02-28,NA,training
""",
    "assembly.csv": """ENABLED,description,population_uid,period_start,period_end,measure_table,measure_uid,measure_start,measure_end,measure_value,output_name,output_method,output_type
TRUE,any,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],[kind],'any',EXISTS,INT
TRUE,days,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],'1','days',DURATION,INT
TRUE,sick days,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],"{IIF([kind] = 'sickness', 1, NULL)}",'sick',DURATION,INT
TRUE,share,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],[amount],'share',SUM_WITHIN,FLOAT
TRUE,payments,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],[amount],'paid',COUNT,INT
TRUE,kinds,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],[kind],'kind',ENTITY,VARCHAR(20)
TRUE,before,[uid],"{DATEADD(YEAR, -1, [start])}","{DATEADD(DAY, -1, [start])}",[db].[dbo].[benefits],[id],[from],[to],[amount],'before',MAX,INT
FALSE,off,[uid],[start],[stop],[db].[dbo].[benefits],[id],[from],[to],[amount],'off',MIN,INT
""",
    "summary.csv": """ENABLED,FILE,LABEL,GROUP,COUNT,SUM,MAX,ENTITY,WHERE,NOTES
TRUE,results.csv,by year,start,days,share,days,kind,,
TRUE,results.csv,long,,days,share,sick,kind,{days > 100},only those with long spells
TRUE,results.csv,in words,,"{ifelse(paste0(days) == '28', uid, NA)}","{ifelse(is.na(any), 1, 0)}",,,,
""",
    "confidential.csv": """cmd,count,sum
ROUND,,CONV100
SUPPRESS,,count < 2
""",
}
ASSEMBLED = {
    (1, "2020-01-01"): (1, 31 + 214 + 10, 31 + 10, 31 + 214 + 100, 3, "sickness", "training", 62),
    (1, "2021-01-01"): (1, 151, None, 151, 1, "training", "training", 365),
    (2, "2020-01-01"): (None,) * 8,
    (3, "2021-01-01"): (1, 28, None, None, 0, "training", "training", None),
}
SUMMARISED = [
    ["label", "grplabel", "group", "count", "sum", "max", "entity"],
    ["by year", "start", "2020-01-01", "1", "345", "255", "2"],
    ["by year", "start", "2021-01-01", "2", "151", "151", "1"],
    ["long", "NA", "NA", "2", "496", "41", "2"],
    ["in words", "NA", "NA", "1", "1", "NA", "NA"],
]


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    folder = tmp_path_factory.mktemp("worked")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    return folder


@pytest.fixture(scope="module")
def built(spark, at):
    people, benefits = (load_csv(spark, str(at / f"{n}.csv")) for n in ("people", "benefits"))
    return run_assembly(spark, str(at / "assembly.csv"), people, {"[db].[dbo].[benefits]": benefits})


def test_assembly(built, at):
    assert built.df.columns[3:] == ["any", "days", "sick", "share", "paid", "kind__min", "kind__max", "before"]
    got = {(r.uid, str(r.start)): tuple(r)[3:] for r in built.df.collect()}
    assert {k: tuple(round(x, 9) if isinstance(x, float) else x for x in v) for k, v in got.items()} == ASSEMBLED
    assert [r["status"] for r in load_control_file(str(at / "assembly.csv")).rows] == [SUCCESS] * 7 + [None]


def test_summary_to_a_file(built, at):
    run_summary(str(at / "summary.csv"), built.df, save_folder=str(at / "out"), write=True)
    with open(at / "out" / "results.csv", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert sorted(rows) == sorted(SUMMARISED) and rows[0] == SUMMARISED[0]
    assert [r["status"] for r in load_control_file(str(at / "summary.csv")).rows] == [SUCCESS] * 3


def test_confidential(built, at):
    summed = run_summary(str(at / "summary.csv"), built.df).df
    safe = run_confidential(str(at / "confidential.csv"), summed)
    assert sorted((r.label, r.group, r["sum"], r.conf_sum) for r in safe.where("label <> 'in words'").collect()) == [("by year", "2020-01-01", 345.0, None), ("by year", "2021-01-01", 151.0, 200.0), ("long", None, 496.0, 500.0)]
    assert safe.columns[-1] == "conf_sum" and safe.where("label = 'in words'").first().conf_sum is None
