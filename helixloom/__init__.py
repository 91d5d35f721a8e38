"""Spark-first transcript assembly and quantification, with corpus tools in ``llm``."""
