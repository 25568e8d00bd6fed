"""Name a value inside a column expression."""

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` standing for ``value``, which is then written and computed once.

    A column used n times in an expression is n copies in the plan; nested, they multiply and the
    generated code outgrows the compiler. A lambda variable keeps the plan linear.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
