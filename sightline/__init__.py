"""HTTP-traffic inventory and findings analytics, expressed as Spark DataFrames.

Everything takes a DataFrame of captured exchanges (``schemas.EXCHANGES``) and
returns DataFrames.  Arrival order never matters: each order-dependent rule names
the ``seq`` column explicitly.
"""
