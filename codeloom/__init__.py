"""codeloom: a Spark-native engine for searching and analysing source trees and text corpora."""

__version__ = "0.1.0"
