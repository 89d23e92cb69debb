"""stagewatch: job stage-event monitoring analytics on Spark DataFrames.

Every operator takes and returns DataFrames; nothing is collected inside an
operator. See README.md for the module map.
"""

__version__ = "0.1.0"
