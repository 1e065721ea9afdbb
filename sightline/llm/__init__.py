"""Training-data operators: classifiers, search, duplicates, formatting, media, tokens, archives, packing.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface and,
in ``entries``, a thin registered query that runs it over a whole table.
"""
