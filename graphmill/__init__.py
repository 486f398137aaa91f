"""Analytics over code and document knowledge graphs, expressed as Spark plans."""
