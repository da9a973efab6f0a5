"""annolake: DataFrame operators for 2D/3D annotation data on Spark."""
