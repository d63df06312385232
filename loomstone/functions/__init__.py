"""Column expressions of the engine; all stay inside Catalyst."""
