"""Line items held as a JSON array in a text column.

The text is parsed once into an array of VARIANT values, which keeps a missing
key, a JSON null, a number and a text apart. All rules below are array
expressions on one row, so none of them needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.columns import as_column, money_text, parse_money


def repair_json(text: Column | str, wrapped_only: bool = False) -> Column:
    """Undo CSV quoting: collapse doubled quotes, strip quotes at both ends.

    ``wrapped_only`` repairs only text that starts with a quote, and so keeps
    the empty strings in text that never was quoted.
    """
    text = as_column(text)
    fixed = F.btrim(F.replace(text, F.lit('""'), F.lit('"')), F.lit('"'))
    return F.when(text.startswith('"'), fixed).otherwise(text) if wrapped_only else fixed


def parse_items(text: Column | str, wrapped_only: bool = False) -> Column:
    """``array<variant>`` of the elements; NULL unless the text is one JSON array.

    The parser accepts trailing characters after a complete value. So the text
    is parsed as the first of two elements, before a mark with the text's length: only a text that
    is one whole value leaves exactly these two. A text that does not parse so, as it
    exceeds a VARIANT, or gives a key twice where the session does not allow that, is
    parsed element by element.
    """

    def parse(text: Column) -> Column:
        document, mark = _marked(text)

        def first(both: Column) -> Column:
            return F.when(_is_one(both, mark), F.try_variant_get(both, "$[0]", "array<variant>"))

        items = _bound(F.try_parse_json(document), first)
        return F.coalesce(items, F.when(_may_be_one(text), parse_elements(text)))

    # through lambdas, so that the text is repaired and parsed once and not for each use
    return _bound(repair_json(text, wrapped_only), parse)


def parse_fields(
    text: Column | str,
    types: Mapping[str, str],
    build: Callable[[Column, Callable[[str], Column]], Column],
    present: Sequence[str] = (),
    wrapped_only: bool = False,
    text_if: Callable[[Column], Column] | None = None,
) -> Column:
    """The elements that ``parse_items`` gives, their keys read as ``types`` at once:
    a struct of ``items``, or NULL unless the text is one JSON array.

    ``build(fields, has)`` makes an item from an element's typed keys; ``has(key)`` is ``has_key``,
    for the ``present`` keys. A value that is not NULL is present, so values are looked up
    untyped only in documents where one of these is NULL. With ``text_if`` the struct has ``texts``
    too, each element as a text, in documents with an item for which it holds.

    All elements are cast in one pass over the document: a VARIANT of its own for each
    element, and a look-up for each of its keys, cost most of the time of a parse.
    """
    typed_as = _array_of(types)
    shown_as = _array_of(dict.fromkeys(present, "variant"))

    def held(typed: Column, shown: Column, texts: Column) -> Column:
        def items(fields: Column) -> Column:
            if not present:
                return F.transform(fields, lambda e: build(e, lambda key: e[key].isNotNull()))
            unsure = F.exists(fields, lambda e: reduce(or_, [e[k].isNull() for k in present]))
            return _bound(
                F.when(unsure, shown),
                lambda known: F.transform(
                    fields,
                    lambda e, i: build(
                        e, lambda key: e[key].isNotNull() | F.get(known, i)[key].isNotNull()
                    ),
                ),
            )

        def with_texts(found: Column) -> Column:
            columns = [found.alias("items")]
            if text_if is not None:
                columns.append(F.when(F.exists(found, text_if), texts).alias("texts"))
            return F.when(found.isNotNull(), F.struct(*columns))

        return _bound(typed, lambda fields: _bound(items(fields), with_texts))

    def of_objects(objects: Column, maps: Column) -> Column:
        typed = F.transform(
            objects,
            lambda o: F.struct(*[F.try_variant_get(o[k], "$", t).alias(k) for k, t in types.items()]),
        )
        texts = F.transform(maps, lambda m: _last_values(m).cast("string"))
        return held(typed, objects, texts)

    def of_elements(elements: Column) -> Column:
        def read(kinds: Mapping[str, str]) -> Column:
            return F.transform(
                elements, lambda e: F.struct(*[get_item(e, k, t).alias(k) for k, t in kinds.items()])
            )

        texts = F.transform(elements, lambda e: e.cast("string"))
        return held(read(types), read(dict.fromkeys(present, "variant")), texts)

    def parse(text: Column) -> Column:
        document, mark = _marked(text)

        def first(both: Column) -> Column:
            get = lambda kind: F.try_variant_get(both, "$[0]", kind)
            shown = get(shown_as) if present else F.lit(None)
            return F.when(_is_one(both, mark), held(get(typed_as), shown, get("array<string>")))

        quick = _bound(F.try_parse_json(document), first)
        def of_maps(maps: Column) -> Column:
            objects = F.when(maps.isNotNull(), _parse_objects(text, types))
            return _bound(objects, lambda o: of_objects(o, maps))

        slow = F.coalesce(
            _bound(_parse_maps(text), of_maps), _bound(parse_elements(text), of_elements)
        )
        return F.coalesce(quick, F.when(_may_be_one(text), slow))

    return _bound(repair_json(text, wrapped_only), parse)


def _array_of(types: Mapping[str, str]) -> str:
    return "array<struct<" + ",".join(f"`{k}`:{t}" for k, t in types.items()) + ">>"


def _is_one(both: Column, mark: Column) -> Column:
    """Whether a marked document parsed to exactly the text's value and the mark."""
    third = F.try_variant_get(both, "$[2]", "variant")
    return (F.try_variant_get(both, "$[1]", "string") == mark) & third.isNull()


def _may_be_one(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\r\n"))
    return bare.startswith("[") & bare.endswith("]")


def _marked(text: Column) -> tuple[Column, Column]:
    """The text as the first of two elements, and the second one."""
    mark = F.concat(F.lit("end of "), F.octet_length(text).cast("string"))
    return F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), mark


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# What stands for a private character, an escaped backslash and an escaped quote.
_HIDE = (("\ue000", "\ue000z"), ("\\\\", "\ue000b"), ('\\"', "\ue000q"))


# What the parser of single values refuses, as the one of whole texts does.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_elements(text: Column) -> Column:
    """``array<variant>`` of a JSON array's elements, each parsed by itself.

    So the size of a VARIANT limits an element and not the text, and of a key given
    twice in an element the last value counts whatever the session's setting. Escaped quotes are
    hidden while the array is split, so that an element which is a text holding an object does
    not become that object; a text element is a JSON null here.
    """
    hidden = text
    for plain, code in _HIDE:
        hidden = F.replace(hidden, F.lit(plain), F.lit(code))
    hidden = F.regexp_replace(hidden, r"\\u[eE]000", _HIDE[0][1])  # the character as an escape

    def split(held: Column) -> Column:
        document, mark = _marked(held)
        both = F.from_json(document, "array<string>", STRICT)
        is_one = F.ltrim(held).startswith("[")  # a text would lose its quotes
        return _bound(
            both,
            lambda e: F.when(
                is_one & (F.size(e) == 2) & (F.get(e, F.lit(1)) == mark), F.get(e, F.lit(0))
            ),
        )

    elements = F.from_json(_bound(hidden, split), "array<string>", STRICT)
    return F.transform(elements, _element)


def _element(text: Column) -> Column:
    """The value of one element's text; a JSON null for what is none."""
    for plain, code in reversed(_HIDE):
        text = F.replace(text, F.lit(code), F.lit(plain))
    held = F.when(text.startswith("{"), F.from_json(text, "map<string,variant>", STRICT))
    object_ = _last_values(held)
    alone = F.concat(F.lit("["), text, F.lit("]"))
    other = F.get(F.from_json(alone, "array<variant>", STRICT), F.lit(0))
    return F.coalesce(object_, other, F.to_variant_object(F.lit(None).cast("map<string,variant>")))


def _last_values(held: Column) -> Column:
    """The object of a map that may give a key twice; of such a key the last value counts."""

    def last(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        behind = lambda i: F.slice(keys, i + 2, F.size(keys))
        return F.filter(entries, lambda e, i: ~F.array_contains(behind(i), e["key"]))

    return _bound(F.map_entries(held), lambda e: F.to_variant_object(F.map_from_entries(last(e))))


def _parse_objects(text: Column, keys: Iterable[str]) -> Column:
    """The ``keys`` of a JSON array of objects as VARIANT values; NULL for any other text.

    Of a key that is given twice the last value counts, whatever the session's setting, so such
    a document needs no parse for each of its elements.
    """
    end = "end of text"
    document = F.concat(
        F.lit("["), text, F.lit(f',[{{"{end}":'), F.octet_length(text).cast("string"), F.lit("}]]")
    )
    kind = "struct<" + ",".join(f"`{k}`:variant" for k in (*keys, end)) + ">"

    def first(both: Column) -> Column:
        mark = F.try_variant_get(F.get(F.get(both, F.lit(1)), F.lit(0))[end], "$", "bigint")
        objects = F.get(both, F.lit(0))
        is_one = (F.size(both) == 2) & (mark == F.octet_length(text))
        return F.when(is_one & ~F.exists(objects, lambda o: o.isNull()), objects)

    return _bound(F.from_json(document, f"array<array<{kind}>>", STRICT), first)


def _parse_maps(text: Column) -> Column:
    """``array<map<string,variant>>`` of a JSON array of objects; a map keeps a key given twice.

    NULL where a value has a key twice and the session does not allow that.
    """
    return F.from_json(text, "array<map<string,variant>>", STRICT)


def has_key(item: Column, key: str) -> Column:
    """True for a present key, even with a JSON null; false for a non-object."""
    return F.try_variant_get(item, f"$.{key}", "variant").isNotNull()


def get_item(item: Column, key: str, type_: str = "string") -> Column:
    """The key's value as ``type_``; NULL when missing, null or not castable."""
    return F.try_variant_get(item, f"$.{key}", type_)


def item_money(item: Column, key: str) -> Column:
    """Amount of an element: only ``$`` is removed, so ``1,234.00`` is no amount."""
    return parse_money(get_item(item, key), strip="$")


def item_money_text(item: Column, key: str) -> Column:
    """``item_money`` as its cleaned text; see ``money_text``."""
    return _bound(get_item(item, key), lambda value: money_text(value, strip="$"))


def prefix_length(items: Column, is_good: Callable[[Column], Column]) -> Column:
    """Number of elements before the first one that is not good; 0 for NULL.

    Never NULL, so that a comparison with it implies no filter on the array.
    """
    flags = F.concat(F.transform(items, is_good), F.array(F.lit(False)))
    return F.coalesce(F.array_position(flags, False).cast("int") - 1, F.lit(0))


def valid_prefix(items: Column, is_good: Callable[[Column], Column]) -> Column:
    """The elements before the first one that is not good."""
    return F.slice(items, F.lit(1), prefix_length(items, is_good))


def explode_items(items: Column, outer: bool = False) -> Column:
    """Position and element per row; no row for NULL and for an empty array.

    ``outer`` gives one row with NULL position for those. The condition keeps
    Spark from inferring a filter on the array, which would be pushed down and
    parse the text again for each of its tests.
    """
    held = F.when(F.size(items) > 0, items)
    return (F.posexplode_outer(held) if outer else F.posexplode(held)).alias("pos", "item")
