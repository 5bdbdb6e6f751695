"""palaver: bulk conversation and transcript analytics on Spark.

Every operator takes and returns DataFrames. Parameters that the original
service read from a clock, a settings file or a network client (``now``,
word lists, the completion client) are explicit arguments here.
"""

__version__ = "0.1.0"
