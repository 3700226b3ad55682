"""PySpark-native engine: structured legal text -> entity/relation graph -> answers and evaluation."""

__version__ = "0.1.0"
