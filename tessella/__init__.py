"""tessella: retrieval, reasoning-trace and corpus analytics on PySpark."""
