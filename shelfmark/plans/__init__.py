"""The analytics jobs, each composed of operators."""
