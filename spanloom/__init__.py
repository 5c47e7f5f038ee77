"""PySpark-native analytics over accelerator profiler traces."""
