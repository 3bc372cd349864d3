"""pairforge: preference-data building blocks expressed as Spark DataFrame jobs.

Sampled answers are joined with their problems, given verdicts, scored,
deduplicated, filtered and ranked per task; from the ranked table the
library derives pass@k metrics, SFT rows, static preference pairs and
per-epoch progressive pairs whose choice follows validation feedback.
Every operator is a ``DataFrame -> DataFrame`` function.
"""

__version__ = "0.1.0"
