"""Context analytics over fleets of source repositories, on PySpark."""
