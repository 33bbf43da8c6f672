"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

#: One word: a run of characters that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
