"""corbel: a PySpark-native engine for repository and text-corpus intelligence."""
