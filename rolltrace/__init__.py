"""rolltrace: audit how a registry changes between snapshots, on Spark."""
