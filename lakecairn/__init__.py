"""Content-addressed dataset analytics as plain DataFrame transformations.

``sources`` make tables of files and edges, ``operators`` are DataFrame in,
DataFrame out, ``functions`` are columns and byte-level functions, ``plans`` holds
configuration and the registered queries, ``streaming`` the change feed.
"""
