"""End-to-end plans, input tables and the registered queries."""
