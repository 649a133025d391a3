"""Column expressions: no session, no UDF, everything stays inside Catalyst."""
