import pytest

from tabloom.plans.combos import cross_product_column_names, expand_compact_summary_groups, generate_combinations, tolower_control_file_cells
from tabloom.sources.controlfile import as_control_table


def groups(table):
    return [tuple(r[c] for c in table.columns if c.startswith("GROUP")) for r in table.rows]


def test_combinations():
    assert cross_product_column_names(["a", "b"], ["c", "d"]) == [["a", "c"], ["b", "c"], ["a", "d"], ["b", "d"]]
    assert cross_product_column_names(["a", "b"], ["a", "b"]) == [["a"], ["b", "a"], ["b"]]
    assert cross_product_column_names(["a", None], ["c", None], always=["z"]) == [["z", "a", "c"], ["z", "c"], ["z", "a"], ["z"]]
    table = generate_combinations(["a", None], [None])
    assert table.columns == ["column1", "column2"] and [list(r.values()) for r in table.rows] == [["a", None]]
    assert len(generate_combinations(["a", "b"], ["a", "b"], drop_dupes_across=False).rows) == 4


def test_compact_notation():
    control = as_control_table([{"GROUP1": "a | b", "GROUP2": "c | d | +", "COUNT": "x"}])
    assert groups(expand_compact_summary_groups(control, [])) == [("a", "c"), ("a", "d"), ("a", None), ("b", "c"), ("b", "d"), ("b", None)]
    names = ["p_one", "p_two", "x_q", "y_q", "pq"]
    control = as_control_table([{"GROUP1": "p_* | z", "GROUP2": "*_q", "COUNT": "x"}])
    assert groups(expand_compact_summary_groups(control, names)) == [("p_one", "x_q"), ("p_one", "y_q"), ("p_two", "x_q"), ("p_two", "y_q"), ("z", "x_q"), ("z", "y_q")]
    with pytest.raises(ValueError):
        expand_compact_summary_groups(as_control_table([{"GROUP1": "q_*"}]), names)


def test_duplicates_and_rows_without_group():
    control = as_control_table([{"GROUP1": "a | b", "GROUP2": "b | a", "COUNT": "x"}, {"GROUP1": "b", "GROUP2": "a", "COUNT": "y"}, {"COUNT": "z"}])
    assert groups(expand_compact_summary_groups(control, [])) == [("a", "b"), ("a", None), ("b", None), ("b", "a")]
    assert len(expand_compact_summary_groups(control, [], drop_no_group=False).rows) == 5


def test_cells_to_lower_case():
    control = as_control_table([{"GROUP": "Region", "WHERE": "{Sex == 'Male' & AGE > 3}", "LABEL": "Keep Me"}])
    (row,) = tolower_control_file_cells(control, ["group", "where"], ["region", "sex", "age", "male"]).rows
    assert row == {"GROUP": "region", "WHERE": "{sex == 'male' & age > 3}", "LABEL": "Keep Me"}
