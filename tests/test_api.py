from pathlib import Path

from tabloom import api
from tabloom.sources.tables import load_csv


def test_every_tool_has_its_names():
    for name in ("run_summary", "run_assembly", "run_confidential", "run_pipeline", "validate_summary", "validate_assembly", "validate_confidential", "validate_pipeline", "apply_random_rounding", "create_stable_seeds", "generate_combinations_df", "sql2id"):
        assert callable(getattr(api, name))


def test_packaged_examples_run(spark, tmp_path):
    for name in ("summary", "assembly", "confidential", "pipeline"):
        api.provide_example(name, str(tmp_path / name))
    at = lambda *p: str(Path(tmp_path, *p))
    got = api.run_summary(at("summary", "control_file.csv"), load_csv(spark, at("summary", "data.csv"), missing=""), save_folder=at("summary"), write=True)
    assert sorted(tuple(r) for r in got.df.where("label = 'people'").select("group1", "count", "entity").collect()) == [("North", 2, 2), ("South", 2, 1)]
    assert Path(at("summary", "results.csv")).read_text().count("\n") == 5
    built = api.run_assembly(spark, at("assembly", "control_file.csv"), load_csv(spark, at("assembly", "master.csv")), {"spells": load_csv(spark, at("assembly", "spells.csv"))}).df
    first, second = built.orderBy("person").collect()
    assert first.days == 31 + 31 and abs(first.paid - (310 + 310)) < 1e-9 and second.days is None
    safe = api.run_confidential(at("confidential", "control_file.csv"), load_csv(spark, at("confidential", "data.csv")))
    assert safe.columns == ["label", "people", "conf_people"] and safe.where("conf_people is null").count() == 1
    control = Path(at("pipeline", "control_file.csv"))
    control.write_text(control.read_text().replace(",.,", f",{control.parent},"))
    assert {r["status"] for r in api.run_pipeline(str(control), spark).rows} == {"Successful completion"}
