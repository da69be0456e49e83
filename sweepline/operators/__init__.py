"""Operators: functions from DataFrame to DataFrame that carry ``frame_id`` and ``point_idx``."""
