"""Operators for preparing training data at corpus scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Every operator takes DataFrames and
returns lazy DataFrames; what has to be cut from its lineage is written as Parquet into the folder named by
``spark.checkpoint.dir`` (see :mod:`pelago.llm.common`).
"""
