"""pressline: company-news and market-reference analytics expressed as Spark plans."""
