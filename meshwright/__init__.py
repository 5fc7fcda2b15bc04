"""Graph analytics and corpus preparation as plain PySpark DataFrame programs."""
