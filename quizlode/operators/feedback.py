"""What a feedback line says: options by name, pairs by arrows, an order, or a text of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

#: Arrows between the two sides of a pair, and where one pair ends and the next begins (the next has an arrow too).
ARROW = r"→|->"
_NEXT_PAIR = rf"[,;]\s*(?=[^,;]*(?:{ARROW}))"

NAMED = "struct<told:array<int>,pairs:map<int,string>,right_order:array<int>,text_answer:string>"


def _padded(x: Column) -> Column:
    return F.concat(F.lit(" "), x, F.lit(" "))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def intervals(said: Column, keys: Column) -> Column:
    """(option, first, start, end) of the options (by position) that a text names, in disjoint stretches of it.

    Texts are match keys. An option is named by its whole words; longer options choose first (of equally long ones the
    first), and each takes the first of its places that overlaps none taken before. first is its first place of all.
    """
    taken = "array<struct<option:int,first:int,start:int,end:int>>"

    def step(acc: Column, o: Column) -> Column:
        n = F.length(o["key"])
        free = F.filter(o["places"], lambda at: ~F.exists(acc, lambda t: (at < t["end"]) & (t["start"] < at + n)))
        own = lambda at: F.struct(o["option"].alias("option"), F.get(o["places"], F.lit(0)).alias("first"), at.alias("start"), (at + n).alias("end"))
        return _bound(F.get(free, F.lit(0)), lambda at: F.when(at.isNotNull(), F.concat(acc, F.array(own(at)).cast(taken))).otherwise(acc))

    def found(whole: Column) -> Column:
        places = lambda k: F.filter(F.sequence(F.lit(1), F.greatest(F.length(whole) - F.length(k), F.lit(1))), lambda at: F.substr(whole, at, F.length(k) + 2) == _padded(k))
        row = lambda k, i: F.struct((-F.length(k)).alias("longest"), i.alias("option"), k.alias("key"), places(k).alias("places"))
        held = F.filter(F.transform(keys, row), lambda o: (o["key"] != "") & (F.size(o["places"]) > 0))
        return F.aggregate(F.array_sort(held), F.array().cast(taken), step)

    return _bound(_padded(said), found)


def pairs(value: Column, keys: Column) -> Column:
    """Positions of options and what arrows lead to from them; an option is one whose key is the left side or in it."""
    sides = F.transform(F.split(value, _NEXT_PAIR), lambda p: F.struct(text.match_key(F.regexp_extract(p, rf"^(.+?)\s*(?:{ARROW})", 1)).alias("left"), F.trim(F.regexp_extract(p, rf"^.+?\s*(?:{ARROW})\s*(.+)$", 1)).alias("right")))
    fits = lambda s: F.filter(F.transform(keys, lambda k, i: F.when((k == s["left"]) | F.contains(s["left"], k), i)), lambda i: i.isNotNull())
    entries = F.transform(F.filter(sides, lambda s: s["right"] != ""), lambda s: F.struct(F.get(fits(s), F.lit(0)).alias("key"), s["right"].alias("value")))
    # the last pair of an option counts
    last = lambda e: F.filter(e, lambda x, k: ~F.exists(F.slice(e, k + 2, F.size(e)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(_bound(F.filter(entries, lambda e: e["key"].isNotNull()), last))


def named(value: Column, options: Column, kind: Column | None = None) -> Column:
    """A struct (told, pairs, right_order, text_answer) of a feedback's value beside options (texts); kind: the question's type.

    Pairs where the question asks for them or arrows are there; else the options named, in the order of their first
    places, which is also the right order of a question that asks for one; else the text itself. Null without a value.
    """
    kind = F.lit(None).cast("string") if kind is None else kind
    no_ids, no_pairs, no_text = F.array().cast("array<int>"), F.lit(None).cast("map<int,string>"), F.lit(None).cast("string")
    out = lambda told, linked, order, said: F.struct(told.alias("told"), linked.alias("pairs"), order.alias("right_order"), said.alias("text_answer"))

    def by_name(ids: Column) -> Column:
        order = F.when(F.coalesce(kind == "ORDERING", F.lit(False)), ids)
        return F.when(F.size(ids) > 0, out(ids, no_pairs, order, no_text)).otherwise(out(no_ids, no_pairs, F.lit(None).cast("array<int>"), value))

    def told(keys: Column) -> Column:
        linked = F.when(F.coalesce(kind == "MATCHING", F.lit(False)) | value.rlike(ARROW), pairs(value, keys))
        ids = F.transform(F.array_sort(F.transform(intervals(text.match_key(value), keys), lambda t: F.struct(t["first"], t["option"]))), lambda t: t["option"])
        some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
        return _bound(linked, lambda x: F.when(some(x), out(no_ids, x, F.lit(None).cast("array<int>"), value)).otherwise(_bound(ids, by_name)))

    keys = F.transform(F.coalesce(options, F.array().cast("array<string>")), text.match_key)
    return F.when(value.isNull() | (F.trim(value) == ""), F.lit(None).cast(NAMED)).otherwise(_bound(keys, told))
