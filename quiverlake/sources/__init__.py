"""Sources, sinks and generated data."""
