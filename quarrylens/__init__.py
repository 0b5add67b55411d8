"""Analytics on PySpark: facts about source code, star schemas, events, text."""
