"""Where frames come from."""

from foliospark.sources.settings import folder_levels, settings_in_force, settings_layers, settings_tree
from foliospark.sources.tables import (
    guid_source,
    slot_source,
    typed_rows,
    warehouse_table,
)

__all__ = [
    "folder_levels",
    "guid_source",
    "settings_in_force",
    "settings_layers",
    "settings_tree",
    "slot_source",
    "typed_rows",
    "warehouse_table",
]
