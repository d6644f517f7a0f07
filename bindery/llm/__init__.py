"""Training-data operators: ten corpus-cleaning methods over `documents`, `pages` and `benchmark`.

Nothing outside this subpackage imports it.
"""
