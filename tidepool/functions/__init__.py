"""Column builders and the few row functions that no expression covers."""
