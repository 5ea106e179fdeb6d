"""All public names in one place, under the names that control-file users know."""

from tabloom.functions.delimiters import add_delimiters, is_delimited, no_obvious_escaping_injection, remove_delimiters
from tabloom.functions.rounding import conventional_rounding as apply_conventional_rounding
from tabloom.functions.rounding import graduated_random_rounding as apply_graduated_random_rounding
from tabloom.functions.rounding import random_rounding as apply_random_rounding
from tabloom.functions.rounding import stable_seeds as create_stable_seeds
from tabloom.functions.rounding import suppress_small as apply_small_count_suppression
from tabloom.operators.assembly import run_assembly, sql_file_exists_and_contains
from tabloom.operators.assembly import validate_assembly_control_file as validate_assembly
from tabloom.operators.confidential import run_confidential, suppression_format_extract
from tabloom.operators.confidential import validate_confidential_control_file as validate_confidential
from tabloom.operators.ddl import add_column_sql as alter_table_add_column
from tabloom.operators.ddl import drop_column_sql as alter_table_drop_column
from tabloom.operators.pipeline import run_pipeline, try_run_py_file, try_run_sql_file, try_run_sql_query
from tabloom.operators.pipeline import validate_pipeline_control_file as validate_pipeline
from tabloom.operators.pipeline_sql import read_and_prepare_sql_code, remove_sql_comments, sql_cmd_mode_fix
from tabloom.operators.summary import run_summary
from tabloom.operators.summary import validate_summary_control_file as validate_summary
from tabloom.operators.types import is_valid_data_type
from tabloom.plans.combos import cross_product_column_names, expand_compact_summary_groups, tolower_control_file_cells
from tabloom.plans.combos import generate_combinations as generate_combinations_df
from tabloom.sources.controlfile import load_control_file, save_control_file_w_progress
from tabloom.sources.controlfile import merge_progress as merge_progress_into_control_file
from tabloom.sources.names import sql2id, tolower_colnames
from tabloom.sources.paths import adjust_file_path_handling, increment_file_name, provide_example, read_lines_utf8, run_time_inform_user, save_code_to_script, warn_if_excel_lockfile
from tabloom.sources.tables import load_csv

__all__ = [n for n in dir() if not n.startswith("_")]
