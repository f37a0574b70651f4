"""phonon: materials-property analytics as Spark DataFrame jobs.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
small result computed by one Spark aggregate). Nothing here pulls a whole
table through the driver.
"""

__version__ = "0.1.0"
