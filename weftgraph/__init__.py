"""A PySpark engine that turns text records into a typed property graph and analyses it."""
