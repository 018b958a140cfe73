"""No streaming operators: the workload holds static layers only.

The joins in ``tidegrid.operators`` read bounded tables and carry no state
between batches.
"""
