"""PySpark-native form targeting, transcript and encounter analytics."""
