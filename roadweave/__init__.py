"""Road-coverage analytics and training-data operators on PySpark DataFrames."""
