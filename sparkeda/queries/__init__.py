"""Query modules; importing this package fills ``registry.QUERIES`` / ``ORACLE``."""

from . import analysis_q, clean_io, dist, explore_q, images_q, ml_q, roles, stats, text_q  # noqa: F401
