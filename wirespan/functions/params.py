"""Parameters of the operators; every default is a fixed value that the results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Distances are pixels. Builders take an instance; nothing is read from the session or the environment."""

    infer_size: int = 512
    tile_size: int = 1024
    tile_overlap: float = 0.5
    scan_overlap: int = 128
    line_score: float = 0.05
    fuse_line_score: float = 0.25
    cli_line_score: float = 0.3
    merge_distance: float = 13.0
    box_expand: float = 25.0
    text_distance: float = 50.0
    width_ratio: float = 0.3
    center_ratio: float = 0.15
    vertical_gap: float = 4000.0
    top_extend: float = 350.0
    bottom_extend: float = 300.0
    merge_attempts: int = 3
    touch: float = 5.0
    aux_expand: float = 50.0
    contract_expand: float = 180.0
    contract_distance: float = 5.0
    max_nodes: int = 20
    max_iou: float = 0.6
    endpoint_padding: float = 8.0
    near_box: float = 30.0
    duplicate_lines: float = 10.0
    labels: tuple[str, ...] = ("signalName", "device", "power", "ground")
    power_name: str = "KL30"
    ground_name: str = "GND"


DEFAULT = Params()
