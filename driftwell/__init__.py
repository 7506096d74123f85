"""Change-data-capture and merge-on-read lakehouse engine on PySpark."""
