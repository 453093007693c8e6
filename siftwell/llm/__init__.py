"""Training-data operators: one module each, queries in :mod:`siftwell.llm.queries`.

Rules that hold for every operator here: it reads only the columns named in its
arguments, other columns of the input are ignored (so clashing names cannot
matter), empty tables give empty tables of the same schema, and repeated rows
give repeated results.
"""
