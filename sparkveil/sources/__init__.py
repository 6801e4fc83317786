"""Sources and sinks: case files, audio manifests, audio files, results and debug bundles."""
