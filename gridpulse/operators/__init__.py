"""Stage operators: functions from DataFrame to DataFrame."""
