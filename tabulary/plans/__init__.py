"""Table bindings and the registered query catalogue with its SQL oracles."""
