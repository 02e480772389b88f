"""Copy-number analytics on Spark DataFrames, plus training-data operators in ``genoframe.llm``."""
