"""Message schemas, scans, payload decoding, calibration files and sinks."""
