"""SQL scripts and notebooks of cells."""

from foliospark.plans.notebook import run_notebook
from foliospark.plans.script import (
    Result,
    run_cell,
    run_script_with_params,
    run_sql_script,
    split_statements,
)

__all__ = [
    "Result",
    "run_cell",
    "run_notebook",
    "run_script_with_params",
    "run_sql_script",
    "split_statements",
]
