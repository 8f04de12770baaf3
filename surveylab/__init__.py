"""surveylab: Spark-native operators for coded survey and record-linked data.

Every public operator takes and returns a lazy ``pyspark.sql.DataFrame`` (or a
``pyspark.ml`` Estimator / Model). Nothing is collected to the driver except
small fitted statistics whose size is bounded by the number of columns or
category levels.
"""

from surveylab.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
