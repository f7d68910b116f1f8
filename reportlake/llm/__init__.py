"""Operations of a training-data pipeline over large document tables.

Nothing else in the library imports this subpackage.  Queries are in
``queries.py``; every other module holds one operator or a part that several
operators use.
"""
