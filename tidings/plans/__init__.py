"""All registered queries."""

from tidings.plans import entries, graph, health, mining, models, relational, search, text, topic_lists, topics  # noqa: F401
from tidings.plans.registry import QUERIES  # noqa: F401
