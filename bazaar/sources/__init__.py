"""Readers for the base tables, the role views the operators expect, and sinks."""

from bazaar.sources.tables import TABLE_SCHEMAS, read_jdbc, read_table
from bazaar.sources.roles import Roles, Shared, TableSet
from bazaar.sources.layout import LaidOut, write_layout
from bazaar.sources.sinks import write_dataset

__all__ = ["read_table", "read_jdbc", "TABLE_SCHEMAS", "Roles", "Shared", "TableSet",
           "LaidOut", "write_layout", "write_dataset"]
