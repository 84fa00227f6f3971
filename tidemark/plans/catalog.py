"""All registered queries."""

from tidemark.plans import catalog_models, catalog_streams, catalog_tables, catalog_windows  # noqa: F401

FLAGSHIP = "window_features_target"
