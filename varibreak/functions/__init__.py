"""Column-level helpers: every function returns a Spark Column unless it says otherwise."""
