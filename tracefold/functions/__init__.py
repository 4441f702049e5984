"""Column functions: one expression each, NULL meaning not measured."""
