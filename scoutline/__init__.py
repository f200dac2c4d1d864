"""scoutline: discovery, resolution and scoring of organisations as Spark DataFrame operators."""
