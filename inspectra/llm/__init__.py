"""Training-data operators for large text corpora (see the README's table).

Each module holds one operator with its own general interface; ``queries``
applies them to the driver's tables.  Nothing outside this folder (and the
pipeline at the repository top) imports it.
"""
