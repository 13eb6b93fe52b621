"""Column and DataFrame functions of the engine."""
