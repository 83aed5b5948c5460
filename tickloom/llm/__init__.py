"""Operations of a training-data pipeline over text and embedding tables.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; the digest queries over the test tables are in
``queries.py``.
"""
