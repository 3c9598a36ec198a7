"""Spanwright: Spark-native analytics over networks of lines.

Submodules are imported on demand, so importing the package starts no JVM and pulls in nothing heavy.
"""

__version__ = "0.1.0"
