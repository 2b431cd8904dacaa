"""Query modes and pipelines composed of operators."""
