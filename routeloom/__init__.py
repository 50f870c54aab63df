"""routeloom: analytics over web-route evidence as ordinary Spark plans."""
