"""quizlens: question-and-answer practice analytics on Spark.

Everything is a function from DataFrames to a DataFrame. Nothing runs at
import and no data rows are collected to the driver (only single numbers such
as a bounded count). A few operators write an intermediate once with
``checkpoint()`` into the shared checkpoint folder, because it is read by
several branches (the bank's term counts, a lemma dictionary, the hot keys of
the smoothed score, closed sessions); that write runs when the DataFrame is
built and is stated in each operator's docstring. Nothing is cached in memory.
"""

__version__ = "0.1.0"
