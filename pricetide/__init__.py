"""Market-signal analytics on PySpark: functions from DataFrame to DataFrame."""
