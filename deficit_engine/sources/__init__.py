"""Inputs and outputs: OMOP projections, code lists, readers, writers."""

from deficit_engine.sources.fixtures import OmopTables, omop_tables
from deficit_engine.sources.io import (
    materialize, read_code_list_csv, table_exists, upload, write_report)
from deficit_engine.sources.omop import load_folder, load_schema

__all__ = ["OmopTables", "load_folder", "load_schema", "omop_tables", "materialize",
           "read_code_list_csv", "table_exists", "upload", "write_report"]
