"""Column builders: built-in expressions only, so that everything stays inside code generation."""
