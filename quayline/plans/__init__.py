"""Ready-made reports: each takes ``Tables`` and parameters and returns a DataFrame."""
