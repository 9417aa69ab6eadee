"""metalens: meta-learning analytics over evaluation tables, as Spark plans.

Every public function takes and returns DataFrames; nothing is collected to the
driver except bounded scalars (a chosen pipeline id per greedy round, a
statistic's degrees of freedom).
"""

__version__ = "0.1.0"
