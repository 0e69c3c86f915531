"""Training-data operators. Modules are imported one by one, so that a worker loads only what its task needs."""
