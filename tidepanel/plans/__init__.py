"""Composed operators: the slice, the stage chain and the lifecycle catalog."""
