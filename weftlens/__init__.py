"""weftlens: text-corpus analytics as declarative Spark plans.

Sub-packages
------------
functions   Column -> Column expressions (normalisers, lexicons, numbers, clocks)
operators   DataFrame -> DataFrame operators (dedup, joins, votes, agreement, ...)
sources     readers for captions, transcripts, diarisation files, workbooks, JSON
plans       query catalogue: every operator as a named query with its SQL oracle
streaming   Structured Streaming versions of the incremental operators
llm         operators for language-model training data (optional sub-package)
"""

__version__ = "0.1.0"
