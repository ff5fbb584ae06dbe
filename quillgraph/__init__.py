"""Entity, event and place analytics over triples, property graphs and texts, as PySpark DataFrame plans."""
