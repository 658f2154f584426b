"""Market-quote analytics on Spark: declarative DataFrame operators over quote, task, event and reference tables."""
