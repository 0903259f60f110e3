"""Training-data operators (op1 to op10) and the registered queries over them.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
