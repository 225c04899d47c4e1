"""End-user workflows composed from the operators."""
