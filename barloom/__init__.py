"""barloom: end-of-day equity analytics and corpus processing on PySpark."""
