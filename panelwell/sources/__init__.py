"""Table scans, row manifests, sinks, and the study views over the test tables."""
