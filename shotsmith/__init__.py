"""shotsmith: Spark-native demonstration selection and batch labelling.

Stages, all expressed as DataFrame / SQL / pyspark.ml jobs:

* sources    -- labelled tables, ranking import/export, result sinks
* functions  -- column expressions (tokens, templates, hashing, vectors, arrays)
* operators  -- retrieval (BM25, cosine, token F1, clusters, random), selection,
                prompt assembly, scoring and decoding
* plans      -- composite jobs and the registered driver queries
* streaming  -- micro-batch retrieval for query files that keep arriving
"""

from shotsmith.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
