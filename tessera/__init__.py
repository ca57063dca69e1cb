"""tessera: a PySpark-native analytics engine for threat-intelligence text."""
