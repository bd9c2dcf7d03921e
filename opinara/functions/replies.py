"""Reading of model replies.

A theme reply should be a JSON object of review number -> list of themes, but models wrap
it in prose, use single quotes, split it into several objects or write Python literals.
The usual forms are parsed by `from_json` in the JVM; what it refuses goes to one pandas
UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from opinara.functions.text import strip
from opinara.functions.themes import canonical_themes
from opinara.vocab import THEMES

_OBJECT = "map<string,string>"

# Section marks of an insight reply, and how many citations count.
INSIGHTS_MARK = "INSIGHTS:"
IDS_MARK = "RELEVANT_IDS:"
MAX_CITATIONS = 5


def json_span(raw: Column) -> Column:
    """From the first opening to the last closing brace or bracket; null if there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)[\{\[].*[\}\]]", 0), F.lit(""))


def native_objects(span: Column, strict: bool = False) -> Column:
    """JSON objects of a reply span as `array<map<string,string>>`, null if not readable.

    The span is put in brackets: an object, or several with commas between them, then form
    one array, and a list becomes a list in a list. Nested values stay JSON text. A mark is
    appended, as Spark would not notice text after a complete value: it is reached only if
    the whole span was read. The first character tells which form to read, as a failed read
    is slow. `strict` takes neither several objects without a list nor single quotes.
    """

    def read(item: str, mark: str) -> Column:
        whole = F.concat(F.lit("["), span, F.lit(f",{mark}]"))

        def checked(items: Column) -> Column:
            same = F.to_json(F.try_element_at(items, F.lit(-1))) == F.lit(mark)
            return F.when(same, F.slice(items, F.lit(1), F.size(items) - 1))

        # Bound to a lambda variable, the text is parsed once and not at each use.
        return F.get(F.transform(F.array(F.from_json(whole, f"array<{item}>")), checked), F.lit(0))

    mark = '{"":"end"}'
    flat = read(_OBJECT, mark)
    nested = read(f"array<{_OBJECT}>", f"[{mark}]")
    if strict:
        flat = F.when(F.size(flat) == 1, flat)
    objects = F.when(F.startswith(span, F.lit("{")), flat).otherwise(
        F.when(F.size(nested) == 1, nested[0])
    )
    if strict:
        objects = F.when(~F.contains(span, F.lit("'")), objects)
    return objects


def literal_objects(span: Column, strict: bool = False) -> Column:
    """JSON text of the objects in a span that may be a Python literal; null if unreadable.

    Rows with a null span cost nothing but their transfer.
    """

    @F.pandas_udf("string")
    def to_json(spans: pd.Series) -> pd.Series:
        import ast
        import json
        import re

        def convert(text):
            # Objects without a list around them are put into one as a last try.
            ways = [(json.loads, text), (ast.literal_eval, text)]
            if re.fullmatch(r"\{.*\}", text, flags=re.S):
                ways.append((json.loads, f"[{text}]"))
            data = None
            for read, source in ways:
                try:
                    data = read(source)
                    break
                except Exception:
                    continue
            if isinstance(data, tuple) and not strict:
                data = list(data)
            if isinstance(data, dict):
                data = [data]
            if not isinstance(data, list):
                return None
            usable = [
                {str(k): v for k, v in item.items() if isinstance(k, str) or not strict}
                for item in data
                if isinstance(item, dict)
            ]
            return json.dumps(usable, default=str)

        return spans.map(convert, na_action="ignore")

    return to_json(span)


def reply_entries(objects: Column) -> Column:
    """Key-value pairs of all objects of a reply, in reply order."""
    present = F.filter(objects, lambda o: o.isNotNull())
    return F.flatten(F.transform(present, F.map_entries))


def entry_names(entries: Column, key: Column) -> Column:
    """Names given for one key: the last entry of that key, as an array of strings.

    A missing key gives an empty array, a single value an array of one, and an object its
    first field.
    """
    value = F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]
    several = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))
    names = F.when(value.isNull(), F.array().cast("array<string>")).otherwise(
        F.coalesce(several, F.array(value))
    )

    def plain(name: Column) -> Column:
        first = F.get(F.map_values(F.from_json(name, _OBJECT)), F.lit(0))
        return F.when(F.startswith(name, F.lit("{")), F.coalesce(first, name)).otherwise(name)

    return F.transform(names, plain)


def themes_by_position(
    entries: Column, size: Column, themes: Sequence[str] = THEMES
) -> Column:
    """Allowed themes of review 1 to `size` of a batch, as an array of arrays."""
    return F.transform(
        F.sequence(F.lit(1), size),
        lambda n: canonical_themes(entry_names(entries, n.cast("string")), themes),
    )


def all_have_themes(by_position: Column) -> Column:
    """Every review of the batch got a theme; one without fails the whole batch."""
    return F.coalesce(F.forall(by_position, lambda t: F.size(t) > 0), F.lit(False))


def insight_text(raw: Column) -> Column:
    """Insight part of a reply; the whole reply if it has no citation section."""
    before = F.split(raw, IDS_MARK)[0]
    text = strip(F.replace(before, F.lit(INSIGHTS_MARK), F.lit("")))
    return F.when(F.contains(raw, F.lit(IDS_MARK)), text).otherwise(raw)


def cited_positions(raw: Column, sample_size: Column) -> Column:
    """First five distinct sample positions cited after the mark, out-of-range ones dropped."""
    cited = F.coalesce(F.get(F.split(raw, IDS_MARK), F.lit(1)), F.lit(""))
    runs = F.regexp_extract_all(cited, F.lit(r"\d+"), F.lit(0))
    numbers = F.transform(runs, lambda r: r.try_cast("bigint"))
    valid = F.filter(numbers, lambda n: (n >= 0) & (n < sample_size))
    return F.slice(F.array_distinct(valid), 1, MAX_CITATIONS)
