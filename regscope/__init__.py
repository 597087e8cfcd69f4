"""regscope: package-registry abuse analytics on Spark.

Operators are plain ``DataFrame -> DataFrame`` functions (``operators/``) over
column expressions (``functions/``); ``plans/`` composes them into the image,
npm and NuGet scoring plans and registers the queries; ``streaming/`` holds the
Structured Streaming twin. See README.md.
"""

__version__ = "0.1.0"
