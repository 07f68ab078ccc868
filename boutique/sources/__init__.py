"""Sources and sinks: canonical schemas, the test-data adapter, table bundles, carts."""
