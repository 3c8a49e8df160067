"""The workloads' queries over lineage-carrying rows, for batches and streams alike."""
