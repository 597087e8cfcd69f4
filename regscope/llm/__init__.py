"""Training-data pipeline operators.

One module per operator; ``queries`` registers them. Nothing outside this
package imports it, apart from ``corpus_pipeline.py`` and the guarded lookup in
``__spark_entry__.py``.
"""
