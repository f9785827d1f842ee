"""Where frames go."""

from foliospark.sinks.archive import (
    child_report,
    destination,
    new_archive,
    publish_fixed,
    publish_run,
    write_child_reports,
)
from foliospark.sinks.overlays import apply_layer, save_overlay, saved_overlay
from foliospark.sinks.settings import save_layer
from foliospark.sinks.tables import materialize, register_view, save_table

__all__ = [
    "apply_layer",
    "child_report",
    "destination",
    "materialize",
    "new_archive",
    "publish_fixed",
    "publish_run",
    "register_view",
    "save_layer",
    "save_overlay",
    "save_table",
    "saved_overlay",
    "write_child_reports",
]
