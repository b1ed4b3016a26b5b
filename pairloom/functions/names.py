"""Person names in a comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short forms of common English given names.
NICKNAMES = {
    "alexander": "alex", "andrew": "andy", "anthony": "tony", "benjamin": "ben", "catherine": "cathy", "charles": "charlie",
    "christopher": "chris", "daniel": "dan", "david": "dave", "deborah": "debbie", "donald": "don", "edward": "ed",
    "elizabeth": "liz", "frederick": "fred", "gregory": "greg", "jacob": "jake", "james": "jim", "jennifer": "jenny",
    "jessica": "jess", "john": "jack", "jonathan": "jon", "joseph": "joe", "joshua": "josh", "katherine": "kate",
    "kenneth": "ken", "lawrence": "larry", "margaret": "maggie", "matthew": "matt", "michael": "mike", "nicholas": "nick",
    "pamela": "pam", "patricia": "pat", "patrick": "pat", "peter": "pete", "philip": "phil", "rebecca": "becky",
    "richard": "rick", "robert": "bob", "ronald": "ron", "samuel": "sam", "stephen": "steve", "steven": "steve",
    "susan": "sue", "theodore": "ted", "thomas": "tom", "timothy": "tim", "victoria": "vicky", "vincent": "vince",
    "walter": "walt", "william": "bill", "zachary": "zach",
}


def normalize_name(name: Column, nicknames: dict[str, str] | None = None) -> Column:
    """Runs of two or more letters a-z of the lower-cased name, short forms put in, sorted, joined by blanks."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z]{2,})"), 1)
    known = NICKNAMES if nicknames is None else nicknames
    if known:
        short = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        # The names are looked up by hash, the map by reading through it: most words are not in it.
        words = F.transform(words, lambda w: F.when(w.isin(list(known)), F.coalesce(short[w], w)).otherwise(w))
    return F.array_join(F.array_sort(words), " ")
