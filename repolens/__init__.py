"""repolens: Spark-native operators for auditing source corpora, change sets,
assistant sessions and settings at scale.

Every operator is a function from DataFrames (plus column names and small
parameters) to a DataFrame.  Planning and execution are Spark's: nothing here
collects data to the driver except loop-termination counts in the iterative
graph operators and the explicit integrity gate.
"""

__version__ = "0.1.0"
