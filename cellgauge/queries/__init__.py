"""Named queries over the driver tables, with their SQL twins."""

from cellgauge.queries import calibration, distances, draw_tables, end_to_end, responses, selection, summary_curves, wells  # noqa: F401
from cellgauge.queries.registry import ORACLES, QUERIES  # noqa: F401
