"""fslink: a Spark-native engine for probabilistic record linkage.

The core package rebuilds a Fellegi-Sunter linkage pipeline as DataFrame plans.  Nothing in it
imports the optional training-data subpackage.
"""
