"""The parameters of the row jobs. The defaults are fixed values that the results depend on."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    tile_m: float = 20.0  # side of a tile
    seed_ranges: tuple = ((-360.0, 360.0), (-90.0, 90.0), (-45.0, 45.0), (0.0, 90.0), (90.0, 180.0))  # seeds -1, 1, 2, 3, 4
    seed_tolerance: float = 3.0  # degrees
    contour_min_px: float = 20.0  # least width and height of a contour's rectangle
    top_contours: int = 10
    kernel_pixel_m: float = 20.0 / 1084  # ground resolution that kernel sizes and least areas are given for
    max_angle_deviation: float = 3.0
    min_line_m: float = 0.4
    min_row_gap_m: float = 1.3
    green_sensitivity: int = 15
    green_min_area: int = 280
    segment_min_area: int = 400
    extend_ratio: float = 500.0
    group_span: float = 1.3
    fold_values: int = 200_000  # distances of one field that one task folds; beyond, sorted ranges
    gap_small: float = 0.4
    gap_large: float = 0.9
    clip_margin_m: float = 20.0
    row_buffer_m: float = 0.3
    corner_probe_m: float = 100.0
    side_probe_m: float = 1.0
    far_probe_m: float = 5000.0


DEFAULTS = Params()

#: What the seeds are called.
SEED_NAMES = {1: "Horizontal", 2: "Vertical", 3: "Counterclockwise", 4: "Clockwise"}
