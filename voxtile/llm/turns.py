"""Speech transcripts into clean, ordered speaker turns (problem 1).

Method: line templates are mined by a token tree of fixed depth. A head of a text is
tokenised into delimiters and slots and walked down four levels: the opener, the class of
the slot's tokens (those with digits are wildcards), their number, and the closer; numbers
with separators anywhere in a text go down the same tree by their delimiters and format.
Leaves count over the whole corpus what their slot holds: how many of its values are
explained by the registry, the roles or the row's own ``speaker``, and how many agree with
the segment's time. From the values each leaf's slot is inferred: "speaker", "mixed",
"time" or "text".

Extraction goes by layout. In a speaker leaf any name, identifier or role is the label,
whether the registry has it or not; in a mixed leaf only values that are explained; in a
text leaf none. Time leaves are dropped wherever they stand, with a label that follows
them inside a text. Cleaning also drops sound notes and fillers, and merging opens a turn
at the first segment of a recording and wherever the person differs from the last known
one.

Scale: mining counts (leaf, label) before its shuffle, and only leaves with more than
1/10,000 of all counts are told to the tasks, so fewer than 10,000; values of rarer leaves
count as mixed. Turns look back within a time chunk of the recording, and a summary with
one row per recording and chunk carries the last known person from chunk to chunk, so a
recording with a third of all rows is spread over many tasks. Labels meet the registry in
salted parts.

Defined results: null ids, null recording ids and starts that are absent or not finite
take no part; a null, empty or blank text has no spoken word; ties in start go by id;
repeated deliveries of one id count once; empty tables give empty results; extra columns
are ignored; a label of a speaker leaf that the registry does not know is a person of its
own, by its key.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.llm.people import label_key, label_key_udf, registry_keys
from voxtile.session import SEGMENT_FIELDS, checkpointed, delivered, first_of, spread, whole_ms

CHUNK_MS = 600_000
MIN_SHARE = 0.5

# Fillers by language; those of other languages stay in a text whose language is known.
FILLERS = {
    "en": "uh um er erm hmm hm mm mhm ah uhm eh huh",
    "de": "äh ähm öh hm ehm",
    "fr": "euh heu hum ben",
    "es": "eh em este ehm",
    "ru": "э э-э эм ммм эээ мм хм ээ",
    "el": "εε εμ χμ ε",
    "hi": "अं उम हम्म अम ऊं",
    "ar": "اه امم يعني آه ممم",
    "th": "เอ่อ อ่า อืม เออ",
    "zh": "呃 嗯 啊 唔",
    "ja": "えーと えっと あの うーん ええと えー",
}
# Codes and names of the languages above.
LANGUAGES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french", "es": "es spa spanish",
    "ru": "ru rus russian", "el": "el ell gre greek", "hi": "hi hin hindi", "ar": "ar ara arabic", "th": "th tha thai",
    "zh": "zh zho chi cmn chinese yue", "ja": "ja jpn jp japanese",
}
CODES = {name: code for code, names in LANGUAGES.items() for name in names.split()}
_FILLER = {code: frozenset(words.split()) for code, words in FILLERS.items()}
_ANY_FILLER = frozenset().union(*_FILLER.values())
_UNSPACED = re.compile("|".join(sorted((w for c in ("zh", "ja", "th") for w in _FILLER[c]), key=len, reverse=True)))
_ENDS = ".,;:!?…。、，！？।؟—–-\"“”‘’"
_STOPS = re.compile(r"[,.;:!?…。、，！？।؟]+")
_LATIN = re.compile(r"[a-z]")
_NOTED = re.compile(r"[\[({<【（*~♪♫%]")

# What the notes in round brackets are about; other round brackets are spoken asides.
_SOUNDS = (
    r"(?:\b(?:laugh|cough|sigh|breath|inhal|exhal|sniff|sneez|throat|clears|nois|music|applau|clap|door|phone|pause|silence|inaudible"
    r"|unintelligible|indistinct|crosstalk|background|static|click|whistl|cheer|sob|yawn)|\b(?:sil|hum|humming|rings?|ringing|beeps?"
    r"|beeping|cry|cries|crying|whisper|whispers|whispering)\b|笑|音乐|音楽|拍手|咳|噪音|雑音)"
)
_NOTE = re.compile(
    r"\[\[[^\[\]]*\]\]|\(\([^()]*\)\)|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}|【[^【】]*】|\*[^*\n]+\*|~[^~\n]+~|♪[^♪\n]*♪|[♪♫]+|%[A-Za-z_]+"
    rf"|[(（][^()（）]*(?:{_SOUNDS})[^()（）]*[)）]",
    re.IGNORECASE,
)
# A number with separators or a unit, and the delimiters around it; a range "from --> to" is one item.
_NUMBER = r"\d+(?:[:.,]\d+){1,3}(?:\s?s\b)?|\d+\s?s\b"
_ITEM = re.compile(
    rf"(?P<o>(?P<open>[\[({{<【（]{{1,2}}\s*)|[@#]\s?|(?<![\w:])(?<!\d[.,]))(?P<v>{_NUMBER})(?P<to>\s*-->(?:\s*(?:{_NUMBER})(?![\w]))?)?"
    r"(?P<c>(?(open)\s*[\])}>】）]{1,2}|(?(to)|(?![\w:]))))"
)
_DIGIT = re.compile(r"\d[:.,]\d|\d\s?s\b")
# A slot between an opener and a closer: in brackets, or up to a delimiter.
_SLOT = re.compile(
    r"(?P<o>[>*#|•~=+]{0,2}\s*)"
    r"(?:(?P<open>[\[<{【]{1,2}|(?P<round>[(（]{1,2}))\s*(?P<a>[^\s\[\]<>{}()（）【】\n][^\[\]<>{}【】\n]{0,59}?)\s*(?P<close>(?(round)[)）]{1,2}|[\]}>】]{1,2})(?:\s?[:：])?)"
    r"|(?P<b>[^\W_][^\n:：|=>→\[\]<>{}（）【】♪*~]{0,59}?)(?P<end>\s?[:：](?!\d)|\s*(?:\|{1,2}|=>?|→|>{1,2})|\s+[-–—](?:\s+|$)))"
)
_DELIMITER = re.compile(r"[\[\](){}<>（）【】:：|=→–—]|\s-")
_NAME_WORD = re.compile(r"(?:[^\W\d_]\.?|[^\W\d_][\w'’\-]*|(?:Dr|Prof|Mr|Mrs|Ms|Mx)\.)")
# Words that head a line and name nobody.
HEADINGS = frozenset("note notes warning summary question answer q example topic title subject date time place remark remarks todo update chapter part section".split())


def seconds_of(value: str) -> float | None:
    """A clock or a decimal in seconds; None where its minutes or seconds exceed 59."""
    whole = value.rstrip("s ").replace(",", ".").split(":")
    try:
        parts = [float(x) for x in whole]
    except ValueError:
        return None
    if any(x >= 60 for x in parts[1:]) or len(parts) > 3:
        return None
    total = 0.0
    for x in parts:
        total = total * 60 + x
    return total


def _items(text: str) -> Iterator[re.Match]:
    return _ITEM.finditer(text) if _DIGIT.search(text) else iter(())


def _item_path(m: re.Match) -> str:
    number = re.sub(r"\d+", "#", m["v"]).replace(" ", "")
    return f"{m['o'].strip()}|{number}|{'-->' if m['to'] else ''}{m['c'].strip()}"


def _token_class(slot: str) -> str:
    """The class of a slot's tokens and their number: the inner levels of the tree."""
    tokens = slot.split()
    if any(c.isdigit() for c in slot):
        kind = "*" if any(c.isalpha() for c in slot) else "#"
    else:
        kind = "joined" if len(tokens) == 1 and "_" in slot else "word"
    return f"{kind}|{min(len(tokens), 4)}"


class Layouts:
    """What the slots of the mined leaves hold; leaves that are not known count by their form."""

    def __init__(self, kinds: dict[str, str] | None = None):
        self.kinds = kinds or {}

    def is_time(self, m: re.Match) -> bool:
        kind = self.kinds.get(_item_path(m))
        if kind is not None:
            return kind == "time"
        delimited = bool(m["o"].strip() or m["to"] or m["c"].strip())
        return delimited and seconds_of(m["v"]) is not None

    def of_slot(self, path: str) -> str:
        return self.kinds.get(path, "mixed")


def _is_sound(slot: str) -> bool:
    return re.search(_SOUNDS, slot.replace("_", " ").replace("/", " "), re.I) is not None


def _slot_at(text: str, at: int) -> tuple[str, str, int] | None:
    """(path, slot, end) of the layout that begins at a place."""
    m = _SLOT.match(text, at)
    if m is None:
        return None
    slot = (m["a"] if m["a"] is not None else m["b"]).strip()
    opener = m["o"].strip() + (m["open"] or "")
    closer = (m["close"] or m["end"]).replace(" ", "").replace("：", ":").strip()
    closer = "-" if closer in "–—-" else closer
    return f"{opener or 'none'}|{_token_class(slot)}|{closer}", slot, m.end()


def head_slots(text: str, layouts: Layouts | None = None) -> Iterator[tuple[str, str, int]]:
    """(path, slot, end) of the layouts at the head of a text, first to last.

    Numbers with delimiters are passed over, or with mined layouts those that are times;
    bracketed slots may stand one after another, a slot that is not bracketed is the last.
    """
    at = 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        m = _ITEM.match(text, at)
        if m and (layouts is None or layouts.is_time(m)):
            at = m.end()
            continue
        found = _slot_at(text, at)
        if found is not None:
            yield found
            if found[0].rsplit("|", 1)[1][:1] in "])}>）】":
                at = found[2]
                continue
            return
        if n := _NOTE.match(text, at):
            at = n.end()
            continue
        return


def _may_be_label(slot: str) -> bool:
    """Whether a slot's value looks like a name or an identifier, and not like a heading or a clause."""
    words = slot.replace(",", " ").replace("_", " ").split()
    if not words or len(words) > 4 or slot.casefold() in HEADINGS or _is_sound(slot):
        return False
    if any(c.isdigit() for c in slot):
        return len(words) <= 3 and any(c.isalpha() for c in slot)
    return all(_NAME_WORD.fullmatch(w) and not w[0].islower() for w in words)


def label_of(text: str, layouts: Layouts) -> tuple[str | None, bool, int]:
    """(key, sure, end of the head): the label at the head; ``sure`` where its leaf decides, else the registry has to know the key."""
    maybe = sound = None
    for path, slot, end in head_slots(text, layouts) if _DELIMITER.search(text) else ():
        kind = layouts.of_slot(path)
        if kind not in ("speaker", "mixed") or (key := label_key(slot)) is None:
            continue
        if (key.startswith("role:") and not _is_sound(slot)) or (kind == "speaker" and _may_be_label(slot)):
            return key, True, end
        # a name may begin like a sound: the registry tells
        if _is_sound(slot):
            sound = sound or (key, False, end)
        else:
            maybe = maybe or (key, False, end)
    return maybe or sound or (None, False, 0)


def language_of(code: str | None) -> str | None:
    return None if code is None else CODES.get(re.split(r"[-_]", code.strip().lower())[0])


def _without_times(text: str, layouts: Layouts) -> str:
    """The text without the items of time leaves, and without a label of a speaker leaf that follows one inside it."""
    out, at = [], 0
    for m in _items(text):
        if m.start() < at or not layouts.is_time(m):
            continue
        out += [text[at : m.start()], " "]
        at = m.end()
        gap = len(text[at:]) - len(text[at:].lstrip())
        found = _slot_at(text, at + gap) if out[0].strip() or len(out) > 2 else None
        if found and layouts.kinds.get(found[0]) == "speaker" and label_key(found[1]) and _may_be_label(found[1]):
            at = found[2]
    return "".join([*out, text[at:]])


def clean(text: str, language: str | None = None, layouts: Layouts | None = None) -> str:
    """The text without time stamps, sound notes and fillers; spaces are single."""
    t = _without_times(text if text.isascii() else unicodedata.normalize("NFC", text), layouts or Layouts())
    if _NOTED.search(t):
        t = _NOTE.sub(" ", t)
    t = re.sub(r"^\s*>>\s*", "", t)
    fillers = _FILLER.get(language, _ANY_FILLER)
    kept = []
    for token in t.split():
        core = token.strip(_ENDS).casefold()
        if core in fillers or (not core and not kept):
            continue
        kept.append(token)
    return " ".join(kept).strip()


def has_spoken_word(cleaned: str) -> bool:
    """Whether a letter or digit is left beside fillers of any language."""
    for token in cleaned.split():
        core = token.strip(_ENDS + "()（）[]{}<>*~").casefold()
        if core in _ANY_FILLER:
            continue
        if core.isascii() and core.isalnum():
            return True
        parts = [p for p in _STOPS.split(core) if p]
        if parts and all(p in _ANY_FILLER for p in parts):
            continue
        if not _LATIN.search(core):
            core = _UNSPACED.sub("", core)
        if any(c.isalnum() for c in core):
            return True
    return False


_COUNTS = "path string, key string, n long, known long, near long, clock long"


def _counted(texts: list, starts: list, said: list) -> Counter:
    """Counts of (path, key, field) over a batch; numbers have no key."""
    out: Counter = Counter()
    for text, start, own in zip(texts, starts, said):
        if not text:
            continue
        for path, slot, _ in head_slots(text) if _DELIMITER.search(text) else ():
            key = None if path.split("|")[2] == "4" else label_key(slot)
            out[path, key, "n"] += 1
            if key is not None and (key == own or (key.startswith("role:") and not _is_sound(slot))):
                out[path, key, "known"] += 1
        for m in _items(text):
            path, value = _item_path(m), seconds_of(m["v"])
            out[path, None, "n"] += 1
            if value is not None:
                out[path, None, "clock"] += 1
                if start is not None and -1.5 <= value - start <= 1.5:
                    out[path, None, "near"] += 1
    return out


def mine_layouts(rows: DataFrame, registry: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(path, kind, n, share): the leaves of the tree and what their slot holds, of rows (text, start, said).

    A slot is a time where its values mostly lie by the segment's own start, or mostly are
    clocks between delimiters; a speaker where at least ``min_share`` of its values are
    explained; mixed where some are, else text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _counted(*[c.to_pylist() for c in b.columns])
            keys = list({(p, k) for p, k, _ in got})
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.string())]
                + [pa.array([got[p, k, f] for p, k in keys], pa.int64()) for f in ("n", "known", "near", "clock")],
                names=["path", "key", "n", "known", "near", "clock"],
            )

    counted = rows.select("text", "start", "said").mapInArrow(run, _COUNTS)
    counted = counted.groupBy("path", "key").agg(*[F.sum(c).alias(c) for c in ("n", "known", "near", "clock")])
    # numbers, and heads of many words, have no key: one row for each path
    told = counted.join(registry, "key", "left")
    leaf = told.groupBy("path").agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("person").isNotNull(), F.col("n")).otherwise(F.col("known"))) / F.sum("n")).alias("share"),
        (F.sum("near") / F.sum("n")).alias("near"), (F.sum("clock") / F.sum("n")).alias("clock"),
    )
    delimited = ~(F.col("path").startswith("|") & F.col("path").endswith("|"))
    clock = delimited & F.col("path").contains(":#") & (F.col("clock") >= 0.9)
    kind = (
        F.when((F.col("near") >= min_share) | clock, "time").when(F.col("share") >= min_share, "speaker")
        .when(F.col("share") > 0, "mixed").otherwise("text")
    )
    return leaf.select("path", kind.alias("kind"), "n", "share")


def told_layouts(leaves: DataFrame) -> Layouts:
    """The leaves with more than 1/10,000 of all counts, by arithmetic fewer than 10,000, for the tasks."""
    leaves = checkpointed(leaves)
    total = leaves.agg(F.sum("n").alias("n")).first()["n"] or 0
    return Layouts({r["path"]: r["kind"] for r in leaves.where(F.col("n") * 10_000 > total).select("path", "kind").collect()})


_PARSED = (
    T.StructType().add("key", "string").add("sure", "boolean").add("words_after_head", "boolean").add("words", "boolean")
    .add("head", "string").add("rest", "string")
)


def _parser(layouts: Layouts, with_text: bool):
    @F.pandas_udf(_PARSED)
    def parse(text: pd.Series, language: pd.Series) -> pd.DataFrame:
        """The label at the head, and the text cleaned: its head and the rest, so that either can be put together."""
        rows = []
        for t, code in zip(text, language):
            if not t:
                rows.append((None, False, False, False, None, None))
                continue
            lang = language_of(code)
            key, sure, end = label_of(t, layouts)
            head = "" if sure or not end else clean(t[:end], lang, layouts)
            rest = clean(t[end:], lang, layouts)
            after = has_spoken_word(rest)
            rows.append((key, sure, after, after or has_spoken_word(head), head if with_text else None, rest if with_text else None))
        return pd.DataFrame(rows, columns=_PARSED.names)

    return parse


SALTS = 4


def _with_person(rows: DataFrame, key: str, registry: DataFrame, name: str) -> DataFrame:
    """Adds the person of a key by the registry: keys are split into parts, null ones are spread by id. No key begins with a zero."""
    parts = registry.select(F.col("key").alias("__k"), F.col("person").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part"))
    spread_by = F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.xxhash64("id").cast("string")))
    rows = rows.withColumn("__k", spread_by).withColumn("__part", F.pmod(F.xxhash64("id", "recording_id"), F.lit(SALTS)).cast("int"))
    return rows.join(parts, ["__k", "__part"], "left").drop("__k", "__part")


def labelled_segments(supervision: DataFrame, speakers: DataFrame, with_text: bool = True, layouts: Layouts | None = None) -> DataFrame:
    """(recording_id, id, start_ms, person, text): the segments with a start and a spoken word; person is null where nobody is told."""
    # Texts are parsed before the shuffle that drops repeated deliveries: all that follows reads that one shuffle.
    raw = delivered(supervision.where("id is not null"), SEGMENT_FIELDS).withColumn("start_ms", whole_ms(F.col("start")))
    raw = spread(raw.select("id", "recording_id", "start", "start_ms", "text", "language", "speaker", "__rank"))
    raw = raw.withColumn("said", label_key_udf("speaker"))
    registry = checkpointed(registry_keys(speakers))  # read three times below
    layouts = told_layouts(mine_layouts(raw, registry)) if layouts is None else layouts
    kept = ["key", "sure", "words_after_head", "words", *(["head", "rest"] if with_text else [])]
    parsed = raw.withColumn("t", _parser(layouts, with_text)("text", "language"))
    parsed = parsed.select("id", "recording_id", "start_ms", "__rank", "said", *[f"t.{c}" for c in kept])
    segs = first_of(parsed, "id", ["recording_id", "start_ms", "said", *kept]).where("recording_id is not null and start_ms is not null")
    # a label in the text is looked up only where it could tell the person, or where its leaf leaves open whether it is one
    wanted = F.col("key").isNotNull() & (~F.col("sure") | F.col("said").isNull())
    asked = _with_person(segs.where(wanted), "key", registry, "text_registered")
    full = asked.unionByName(segs.where(~wanted).withColumn("text_registered", F.lit(None).cast("string")))
    full = _with_person(full, "said", registry, "said_registered")
    labelled = F.col("sure") | F.col("text_registered").isNotNull()
    full = full.withColumn("labelled", labelled).where(F.when(labelled, F.col("words_after_head")).otherwise(F.col("words")))
    person = F.coalesce("said_registered", "said", F.when(F.col("labelled"), F.coalesce("text_registered", "key")))
    text = [F.when(F.col("labelled"), F.col("rest")).otherwise(F.trim(F.concat_ws(" ", "head", "rest"))).alias("text")] if with_text else []
    return full.select("recording_id", "id", "start_ms", person.alias("person"), *text)


def mark_turns(segs: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Adds ``opens``: whether a segment opens a turn."""
    segs = segs.withColumn("chunk", F.floor(F.col("start_ms") / chunk_ms)).repartition("recording_id", "chunk")
    within = Window.partitionBy("recording_id", "chunk").orderBy("start_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("start_ms", "id")
    summary = segs.groupBy("recording_id", "chunk").agg(F.max_by("person", F.when(F.col("person").isNotNull(), place)).alias("last_person"))
    carried = summary.select(
        "recording_id", "chunk",
        F.last("last_person", ignorenulls=True).over(before).alias("carried"),
        (F.count(F.lit(1)).over(before) == 0).alias("first_chunk"),
    )
    local = segs.withColumn("prev", F.last("person", ignorenulls=True).over(within)).withColumn("first_row", F.count(F.lit(1)).over(within) == 0)
    joined = local.join(carried, ["recording_id", "chunk"])
    known = F.coalesce("prev", "carried")
    opens = (F.col("first_chunk") & F.col("first_row")) | (F.col("person").isNotNull() & (known.isNull() | (known != F.col("person"))))
    return joined.withColumn("opens", opens).drop("prev", "first_row", "carried", "first_chunk")


def turn_openers(supervision: DataFrame, speakers: DataFrame) -> DataFrame:
    """(recording_id, id) of the segments that open a turn."""
    return mark_turns(labelled_segments(supervision, speakers, with_text=False)).where("opens").select("recording_id", "id")


def turns(supervision: DataFrame, speakers: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(recording_id, start_ms, id, person, n_segments, text): the turns in order of start_ms and id, one row and one person each.

    Segments are put together within their chunks first; the parts of a turn that runs on
    over chunk borders then meet, one per chunk.
    """
    # read three times below: written once
    marked = checkpointed(mark_turns(labelled_segments(supervision, speakers), chunk_ms))
    upto = Window.partitionBy("recording_id", "chunk").orderBy("start_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    opener = F.last(F.when(F.col("opens"), F.struct("start_ms", "id", "person")), ignorenulls=True).over(upto)
    local = marked.withColumn("opener", opener)
    before = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.where("opens").groupBy("recording_id", "chunk").agg(F.max(F.struct("start_ms", "id", "person")).alias("o"))
    every = marked.select("recording_id", "chunk").distinct().join(last, ["recording_id", "chunk"], "left")
    carried = every.select("recording_id", "chunk", F.last("o", ignorenulls=True).over(before).alias("carried"))
    full = local.join(carried, ["recording_id", "chunk"]).withColumn("t", F.coalesce("opener", "carried"))
    joined = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "text"))), lambda x: x["text"]), " ").alias("text")
    parts = full.groupBy("recording_id", "chunk", "t").agg(F.count(F.lit(1)).alias("n"), joined(["start_ms", "id"]))
    whole = parts.groupBy("recording_id", "t").agg(F.sum("n").alias("n_segments"), joined(["chunk"]))
    return whole.select("recording_id", "t.start_ms", "t.id", "t.person", "n_segments", "text")
