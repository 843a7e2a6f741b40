"""Who a speaker label names: a person of the registry, a role inside the recording, or nobody.

A label is reduced to a lookup key; labels with one key name one person:

* ``#n``: an identifier, whatever its prefix, padding, digits or channel suffix;
* ``n:first last``: a full name in either order, with or without a title;
* ``i:f last``: an initial and a last name, if one person of the registry fits;
* ``role:x``: a role or an anonymous diarisation label, a person inside its recording only;
* null: a label that names nobody.

Keys are resolved by an equi-join with the registry's own keys, never by a broadcast of
the registry; labels are made distinct first, so a label on a third of all rows costs no
more than any other.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that name nobody.
NOBODY = frozenset(
    ["", "-", "--", "?", "??", "_", "n/a", "na", "nil", "none", "null", "tbd", "tba", "unk", "unknown", "unknown speaker",
     "unspecified", "anonymous", "crowd", "multiple", "several", "various", "all", "everyone", "overlap", "noise"]
)
# Roles inside a recording.
ROLES = frozenset(
    ["agent", "caller", "host", "guest", "chair", "chairperson", "moderator", "interviewer", "interviewee", "narrator",
     "operator", "customer", "client", "teacher", "student", "lecturer", "presenter", "doctor", "patient", "participant",
     "reporter", "anchor", "translator", "interpreter", "panelist", "audience member"]
)
_IDENT = re.compile(r"(?:spk|speaker|spkr|s)[\s_#.-]*(\d+)")
_ANON = re.compile(r"(?:spk|speaker|spkr|s)[\s_#.-]*(\d{1,2}|[a-z])")
_TITLE = re.compile(r"(?:(?:dr|prof|mr|mrs|ms|mx|sir|hr|fr|frau|herr)\.?\s+)+")
_CHANNEL = re.compile(r"\s*\((?:ch|channel)\s*\d+\)$")


def fold(text: str) -> str:
    """Case, accents, width and spacing put aside."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return " ".join("".join(c for c in t if not unicodedata.combining(c)).split())


def label_key(label: str | None) -> str | None:
    """The lookup key of a label; None where it names nobody."""
    if label is None:
        return None
    k = fold(label).rstrip(": ").strip()
    while len(k) > 1 and (k[0], k[-1]) in {("[", "]"), ("<", ">"), ("(", ")"), ("{", "}")} and k not in NOBODY:
        k = k[1:-1].strip()
    if k in NOBODY or not any(c.isalnum() for c in k):
        return None
    k = _CHANNEL.sub("", k)
    if m := _IDENT.fullmatch(k):
        return f"#{int(m[1])}" if len(m[1]) > 2 else f"role:{int(m[1])}"
    if m := _ANON.fullmatch(k):
        return f"role:{m[1]}"
    if k in ROLES or (len(k) == 1 and k.isalpha()):
        return f"role:{k}"
    k = _TITLE.sub("", k)
    if "," in k:
        last, first = (p.strip() for p in k.split(",", 1))
    elif "_" in k:
        last, first = (p.strip() for p in k.split("_", 1))
    else:
        first, _, last = k.rpartition(" ")
    if m := re.fullmatch(r"(\w)\.?", first):
        return f"i:{m[1]} {last}"
    return f"n:{first} {last}".strip() if first else f"n:{last}"


def key_of(labels: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([known[x] if x in known else known.setdefault(x, label_key(x)) for x in labels], dtype=object)


label_key_udf = F.pandas_udf(key_of, T.StringType())


def registry_keys(speakers: DataFrame) -> DataFrame:
    """(key, person) of the people: identifier, full name, and initial with last name where it fits one person."""
    people = speakers.where("speaker_id is not null").select("speaker_id", "name").distinct()
    named = people.select("speaker_id", label_key_udf("speaker_id").alias("k1"), label_key_udf("name").alias("k2"))
    initial = F.when(F.col("k2").startswith("n:"), F.concat(F.lit("i:"), F.substring("k2", 3, 1), F.lit(" "), F.regexp_extract("k2", r"(\S+)$", 1)))
    keys = named.select("speaker_id", F.explode(F.array("k1", "k2", initial)).alias("key")).where("key is not null and key not like 'role:%'")
    return keys.groupBy("key").agg(F.min("speaker_id").alias("person"), F.countDistinct("speaker_id").alias("n")).where("n = 1").drop("n")


def resolve(keys: DataFrame, speakers: DataFrame) -> DataFrame:
    """(key, person, known) for a column ``key``: persons by the registry, roles as they are.

    A key that neither the registry nor the roles explain is a person of its own in the
    column ``speaker`` (known = false), and no evidence of a label inside a text.
    """
    distinct = keys.where("key is not null").select("key").distinct()
    found = distinct.join(registry_keys(speakers), "key", "left")
    role = F.col("key").startswith("role:")
    return found.select(
        "key",
        F.coalesce("person", "key").alias("person"),
        (F.col("person").isNotNull() | role).alias("known"),
        role.alias("is_role"),
    )
