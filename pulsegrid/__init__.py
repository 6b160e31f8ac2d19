"""Analytics over continuous patient-monitoring telemetry, as DataFrame operators shared by batch and streaming."""
