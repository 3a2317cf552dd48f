"""amperflow: a PySpark-native engine for battery and device telemetry, and for training-data pipelines."""
