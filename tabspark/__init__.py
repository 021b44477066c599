"""Spark-native analysis of recognised tablature scores, and corpus operators in ``tabspark.llm``."""
