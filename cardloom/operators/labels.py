"""Values that stand after a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import digits, first_match, let

# Labels of each field.
LABELS = {"name": "name|full name", "email": "e-?mail", "phone": "phone|telephone|tel|mobile|cell", "title": "title|position|role|job title", "location": "location|address|office|city"}


def label_value(nodes: Column, field: str) -> Column:
    """The value of a field by its label in the nodes' own texts: what follows the colon (over two characters), else the first of the next
    four texts of 3 to 99 characters that is no label itself; an address of it, or a phone of seven digits, where the field is one."""
    every = "|".join(LABELS.values())
    own = F.filter(F.transform(nodes, lambda n: n["own"]), lambda t: t != "")

    def beside(own: Column, here: Column) -> Column:
        after = F.trim(F.regexp_replace(F.get(own, here), r"^[^:]*:?", ""))
        following = F.filter(F.slice(own, here + 2, F.lit(4)), lambda t: F.length(t).between(3, 99) & ~t.rlike(rf"(?i)^({every})\s*:?\z"))
        return F.when(here.isNotNull(), F.coalesce(let(after, lambda a: F.when(F.length(a) > 2, a)), F.get(following, 0)))

    at = lambda own: F.filter(F.transform(own, lambda t, i: F.when(t.rlike(rf"(?i)^({LABELS[field]})\s*(:|\z)"), i)), lambda i: i.isNotNull())
    said = let(own, lambda o: let(F.get(at(o), 0), lambda here: beside(o, here)))
    return let(said, lambda value: {"email": F.lower(first_match(value, V.EMAIL)), "phone": F.when(F.length(digits(value)) >= 7, F.trim(value))}.get(field, F.trim(value)))
