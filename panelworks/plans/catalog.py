"""All registered queries of the library's own operators."""

from panelworks.plans import q_aggregate, q_annotate, q_clean, q_estimate, q_joins, q_network, q_sources, q_spatial  # noqa: F401
from panelworks.plans.registry import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
