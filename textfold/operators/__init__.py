"""DataFrame operators, grouped by the survey's sections."""
