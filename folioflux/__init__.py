"""folioflux: a Spark-native document-intelligence and corpus engine."""
