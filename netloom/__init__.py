"""netloom: network propagation, tail statistics and corpus preparation on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
starts a session by itself except :func:`netloom.plans.session.local_session`.
"""

__version__ = "0.1.0"
