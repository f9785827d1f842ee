"""Fan-out over rows, partitions and slots; overlays; previews."""

from foliospark.operators.fanout import (
    distribute,
    distribute_eval,
    map_eval,
    map_groups_tagged,
    map_isolated,
    map_partitions_tagged,
    report_index,
    slot_count,
    spread,
    spread_by_weight,
)
from foliospark.operators.overlay import overlay
from foliospark.operators.preview import preview, render_markdown
from foliospark.operators.sql_functions import register_group_function, register_row_function

__all__ = [
    "distribute",
    "distribute_eval",
    "map_eval",
    "map_groups_tagged",
    "map_isolated",
    "map_partitions_tagged",
    "overlay",
    "preview",
    "register_group_function",
    "register_row_function",
    "render_markdown",
    "report_index",
    "slot_count",
    "spread",
    "spread_by_weight",
]
