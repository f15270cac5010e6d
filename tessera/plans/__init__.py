"""All queries of the core, gathered on import."""

from tessera.plans import frames, quality, scalar  # noqa: F401
