"""Multi-step analyses: fitting, validation, and the named queries over the driver's tables."""
