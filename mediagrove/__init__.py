"""mediagrove: a catalog analytics and corpus preparation library on PySpark."""
