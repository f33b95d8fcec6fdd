"""All registered queries over the tables."""

from clausewise.queries import analyses, composites, domain, more, relational, texts  # noqa: F401
from clausewise.queries.registry import QUERIES, SQL  # noqa: F401
