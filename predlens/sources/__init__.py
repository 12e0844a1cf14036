"""Sources, sinks and the registry of named datasets."""
