"""sparkbags: phases of tasks over named, schema-carrying collections, on Spark."""
