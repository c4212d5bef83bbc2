"""Query plans: ordering helpers and the registered query catalog."""
