"""claimspark: healthcare-claims analytics as lazy Spark DataFrame functions.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
never collects data to the driver.  Sub-packages:

``sources``    dataset catalog, claims views over the test tables, CSV reader
``functions``  column expressions (lenient dates, month text, age, flags, labels)
``operators``  the star-join extract, dbt-style models and marts, app
               aggregates, provider set operations and cohorts
``sinks``      CSV extract, publish, register, export and materialise
``plans``      session settings, shared-folder helpers and plan inspection
``streaming``  incremental refresh of the modifier dataset (file stream)
"""

__version__ = "0.1.0"
