"""Lexwarden: a PySpark-native engine for multilingual safety-classification data.

Every operator is a ``DataFrame -> DataFrame`` function that declares a plan and runs no action,
except the validators, the iterative operators and the readers that count lines, which say so.  ``lexwarden.llm`` holds
the operators for training-data pipelines; nothing else imports it.
"""

__version__ = "0.1.0"
