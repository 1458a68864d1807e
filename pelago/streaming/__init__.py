"""Reserved: topics are read as finite batches (see :mod:`pelago.sources.kafka`); there are no streaming operators."""
