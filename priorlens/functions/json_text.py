"""JSON held as text: pointers and walks."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pointer(text: Column, at: str) -> Column:
    """The value at an RFC 6901 pointer, as JSON text (a string without its quotes); null if there is none. A number in the
    pointer is an index of a list or a key of an object, whichever is there."""
    if at == "":
        return text
    if not at.startswith("/"):
        raise ValueError("a JSON pointer begins with a slash or is empty")
    paths = ["$"]
    for part in at[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        name = "['" + part.replace("'", "\\'") + "']"
        paths = [p + x for p in paths for x in ([f"[{part}]", name] if part.isdigit() else [name])]
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


FOUND = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def walk(text: Column, keys: list[str]) -> Column:
    """Every text value under one of the keys, at any depth, with its path; null where the text is no JSON."""

    @F.udf(FOUND, useArrow=True)
    def found(x):
        if x is None:
            return None
        try:
            top = json.loads(x)
        except ValueError:
            return None
        out, left = [], [("$", top)]
        while left:
            path, value = left.pop()
            if isinstance(value, dict):
                below = [(f"{path}.{k}", k, v) for k, v in value.items()]
                out += [(p, k, v) for p, k, v in below if k in keys and isinstance(v, str)]
                left += [(p, v) for p, _, v in below]
            elif isinstance(value, list):
                left += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
        return sorted(out)

    return found(text)
