"""Registered queries over the engine's own operators, each with the SQL it must agree with."""
