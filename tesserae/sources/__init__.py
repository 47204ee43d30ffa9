"""Sources and sinks: media listings, calibration documents, and the container as a data source."""
