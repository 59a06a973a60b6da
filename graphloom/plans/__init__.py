"""Multi-phase runs and the registered queries."""
