"""learnlog: learning-history analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – table readers, the derived history view, file sources and history sinks
* ``functions`` – ``Column -> Column`` helpers (text, time, JSON)
* ``operators`` – ``DataFrame -> DataFrame`` operators (history, analysis, chat, model, vector)
* ``plans``     – the registered queries and their DuckDB oracle SQL
* ``streaming`` – Structured Streaming jobs
"""

from learnlog.session import get_spark, checkpoint_dir  # noqa: F401
