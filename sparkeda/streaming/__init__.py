"""Streaming use of the operators.

The reference works on uploaded files only (no streams). Two things carry over:
row-local operators (text cleanup, filters, bullet extraction, label paths) are
plain column expressions and run unchanged on a ``readStream`` frame; batch
operators (profiles, counts, health) run per micro-batch through
``foreachBatch`` with results appended to a table.
"""

from .micro_batch import profile_each_batch, row_local  # noqa: F401
