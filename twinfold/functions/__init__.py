"""Native Column expressions shared by the operators."""
