"""End-to-end plans: the registered query catalog, its SQL oracles, and the end-to-end build."""
