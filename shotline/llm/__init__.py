"""Training-data operators over the ``documents`` table.

Each module holds one operator with a general interface and the thin query
``opN_<name>(spark, sf_dir)`` that derives the contracted digest columns from
the operator's own output.
"""
