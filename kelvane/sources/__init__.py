"""Sources and sinks: tables, delimited files, JSON reports, SQLite, tails of files, snapshots, catalogs, remembered aggregates and exports."""

from .catalog import Catalog, Refused
from .files import column_for, export_csv, export_json, export_sheets, read_delimited, read_reports, snapshot_digest
from .partials import Partials
from .publish import Snapshots
from .shared import shared_folder
from .sqlite import SqliteSource
from .tables import table
from .tail import TailSource

__all__ = [
    "Catalog", "Partials", "Refused", "Snapshots", "SqliteSource", "TailSource", "column_for", "export_csv", "export_json", "export_sheets", "read_delimited", "read_reports", "shared_folder", "snapshot_digest", "table",
]
