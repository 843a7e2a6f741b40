"""Sentence boundaries across languages and scripts (problem 8).

Method: document-centred disambiguation. What a full stop after a word means is told by
the occurrences of that word that leave no doubt. A stop before a small letter or a comma
ends nothing; one at the end of a paragraph ends a sentence. The document's own
occurrences are asked first, then counts of the same kind over the whole corpus: a word
that meets far fewer ends of paragraphs than stops in general do is an abbreviation, also
where all its stops stand before names. What follows is judged the same way: a word
that the document, or the corpus, writes in small letters is no proper name and may open a
sentence; one that stands capitalised inside sentences is a name. Only words on which
neither has evidence are left to short lists of common abbreviations. Terminators follow
their script: stops that need a space after them, those that don't, spaces between clauses
of Thai, the Greek question mark.

Lines: a break is soft, inside a running sentence, where the line has no terminator and
is about as long as the longest of the document; all other breaks end a sentence, so headings and unpunctuated captions are sentences. Numbering, bullets and
speaker labels at the head of a line belong to what they introduce.

Fixed reaches of two rules: an ellipsis is a hesitation only within 80 characters of the sentence's
start, and a verb of saying is looked for in the 60 characters after a quotation.

Scale: two narrow passes over the texts; the first counts words and aggregates before its
shuffle. Only words with at least 1/50,000 of all stops, or 1/10,000 of all openings, are
told to the tasks, so at most 60,000 whatever the corpus; rarer ones are judged by their
document and their form. The rule is the same at every size.

Defined results: null, empty and blank texts, and texts of control characters only, have
no sentences; a text cut off at the end ends in a sentence; texts of any length are split
whole; repeated rows give repeated rows; empty tables give empty results; extra columns
are ignored. Positions count Unicode code points from 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtile.session import checkpointed, spread

#: Words with at least these shares of all stops and of all openings are told to the tasks.
STOP_SHARE, START_SHARE = 1 / 50_000, 1 / 10_000

# Titles, which stand before names.
TITLES = frozenset(
    """mr mrs ms mx dr prof rev hon st gen col capt lt sgt messrs hr fr frl dipl ing mm mme mmes mlle sr sra srta srs dra dres
    г-н г-жа д-р проф акад им κ κα डॉ श्री पं प्रो د أ""".split()
)
# Abbreviations that stand before what they belong to; the last prior, for words without evidence.
NEVER_LAST = TITLES | frozenset(
    """sr. jr. ph.d no nos nr vol vols fig figs eq ch sec sect par p pp pg min max ca cca approx cf e.g i.e viz vs v est al ed eds
    jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun dept univ assn ave blvd rd tel ext
    abb abs bd bzw z z.b u d.h vgl ggf evtl inkl exkl tab kap s str p.ex ex c.-à-d càd env chap art av
    d dña aprox pág págs núm cap n.º n ул рис табл стр гл см ср т.е т напр ок тыс млн κος π.χ δηλ βλ σελ αρ सं क्र م ص""".split()
)
# Abbreviations that may end a sentence as well; before a capital they do.
MAY_BE_LAST = frozenset(
    """etc p.m a.m inc ltd co corp u.s u.k jr bros ft in hrs mins secs kg km cm mm
    usw u.a o.ä u.ä etc dgl
    etc
    etc ud uds vd
    т.д т.п др г гг в вв руб коп
    κ.λπ κ.ά
    إلخ""".split()
)
# Verbs of saying that follow a quotation, for scripts without capitals.
_SAYING = re.compile(
    r"(?:说|說|问|問|答|道|喊|叫|قال|قالت|سأل|سألت|صاح|صاحت|أجاب|ردّ|कहा|पूछा|बोला|बोली|चिल्लाया"
    r"|\b(?:said|asked|says|replied|shouted|whispered|cried|sagte|fragte|rief|dit|demanda|dijo|preguntó)\b)"
)
# What takes up a quotation or bracket inside a Japanese sentence.
_TAKES_UP = re.compile(r"と|って|が|を|は|に|も|の|で|や|へ|から|まで|など|という")
# Words before a German ordinal.
_BEFORE_ORDINAL = frozenset("am im vom zum beim bis ab seit der die das dem den des jeder jede jedes dieser diese unser unsere und".split())

_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_TERM = re.compile(r"[.!?…。！？｡．؟।॥۔‼⁇⁈⁉;\u037e]+")
_CLOSERS = "\"'”’»›」』）)]】〉》]}｣"
_OPEN_FOR = {"”": "“„", "“": "„", "’": "‘‚", "»": "«", "›": "‹", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "】": "【", "}": "{", "〉": "〈", "》": "《", "｣": "｢"}
_HEAD = re.compile(r"\s*(?:(?:\(?\d{1,3}[.)、．]|[A-Za-z][.)])(?=\s)|[-*•‣◦–—·](?=\s))\s*")
_ITEM = re.compile(r"(?:\(?\d{1,3}[.)、．]|[-*•‣◦·])\s")
_LABEL = re.compile(r"\s*[^\W\d_][\w'’-]{0,30}(?: [\w.'’-]{1,20}){0,2}\s?[:：](?=\s|[^\x00-\x7f])")
_FILE = re.compile(r"[\w-]*[\d_-][\w-]*(?:\.\w+)+|\w+\.(?:wav|flac|sph|mp3|json|jsonl|gz|txt|csv|tar|yaml|parquet)\b")
_UNSPACED = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

_LETTER = re.compile(r"[^\W\d_]")


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


# Letters of the scripts with two cases, and the marks that belong to a letter.
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΆ-Ώ\u0391-\u03a9", "a-zß-öø-ÿа-яёά-ώα-ω"
_MARKS = "".join(chr(c) for c in range(0x300, 0x3100) if unicodedata.category(chr(c))[0] == "M")
_STOPPED = re.compile(rf"(?<![\w.{_MARKS}])([^\W\d_](?:[\w'’º{_MARKS}-]|\.(?=\w))*)\.(?=(\s*)(\S?)(\w*))")
_TOKEN = re.compile(rf"[^\W\d_](?:[\w'’º{_MARKS}-]|\.(?=\w))*")
_INSIDE = re.compile(rf"(?<=[{_LOW},] )[{_UP}][\w’'-]*")
_OPENING = re.compile(rf"(?:\A|[!?]\s|\n)\s*([{_UP}][\w’'-]*)(?!\s?[:：])")
_SMALL = re.compile(rf"(?<![\w.])[{_LOW}]+(?![\w])")


def _key(word: str) -> str:
    """Single letters keep their case: initials and units differ."""
    return word if len(word) == 1 else word.lower()


def stop_kinds(text: str) -> Iterator[tuple[str, str, str]]:
    """(word, kind, the word that follows) for the stops after words, by what follows.

    "inside": a small letter or a comma, so the stop ends no sentence; "end": the end of the
    text or paragraph, or a new item or label, so it does; "capital", "digit", "other": either.
    """
    for m in _STOPPED.finditer(text):
        space, c, after = m[2], m[3], m.end(2)
        if not c:
            kind = "end"
        elif breaks := len(_BREAK.findall(space)):
            if breaks < 2 and not (_ITEM.match(text, after) or _LABEL.match(text, after)):
                continue
            kind = "end"
        elif c in ",;:،、":
            kind = "inside"
        elif not space:
            continue
        elif c.islower():
            if _FILE.match(text, after):
                continue
            kind = "inside"
        else:
            kind = "capital" if c.isupper() else "digit" if c.isdigit() else "other"
        yield _key(m[1].strip("'’-")), kind, c + m[4]


class Corpus:
    """What all documents together show: the kinds of words before stops, and which opening words are common ones."""

    def __init__(self, kinds: dict[str, str] | None = None, openings: dict[str, bool] | None = None):
        self.kinds, self.openings = kinds or {}, openings or {}


class _Document:
    """What one text shows about its own words, and where its lines end hard."""

    def __init__(self, text: str, corpus: Corpus, lists: bool = True):
        self.text, self.corpus, self.lists = text, corpus, lists
        self.small_text = text.lower()
        self.upper = text != self.small_text
        self.lower = text != text.upper()
        # capitals tell something only where both cases occur
        self.cased = self.upper and self.lower and re.search(rf"(?:^|\s)[^\w\s]*[^\W\d_]*[{_UP}][{_LOW}]", text) is not None
        self.greek = re.search(r"[\u0370-\u03ff]", text) is not None
        self._small: frozenset | None = None
        self._inside: frozenset | None = None
        self._stops: dict[str, set[str]] | None = None

    def small_words(self) -> frozenset:
        if self._small is None:
            self._small = frozenset(_SMALL.findall(self.text))
        return self._small

    def inside_capitals(self) -> frozenset:
        """Words that stand capitalised after a small letter or a comma: names, and nouns where these have capitals."""
        if self._inside is None:
            self._inside = frozenset(_INSIDE.findall(self.text)) if self.cased else frozenset()
        return self._inside

    def stops(self) -> dict[str, set[str]]:
        if self._stops is None:
            self._stops = {}
            # where letters have no cases only the ends tell
            for word, kind, _ in stop_kinds(self.text) if self.cased or not (self.upper or self.lower) else ():
                if kind in ("inside", "end"):
                    self._stops.setdefault(word, set()).add(kind)
        return self._stops

    def kind_of(self, word: str) -> str:
        """title: never last, before names; inner: never last; either: may be last; word: not abbreviated.

        The document's own stops decide, then the corpus, then the lists, then the word's form.
        """
        key = _key(word)
        known = self.corpus.kinds.get(key)
        # in a short text a plain count tells quickly that a word has this one stop only
        once = len(self.text) < 20_000 and (self.text if len(key) == 1 else self.small_text).count(key + ".") < 2
        own = None if once else self.stops().get(key)
        if own == {"inside"}:
            return known if known in ("title", "either") else "inner"
        if own == {"inside", "end"}:
            return "either"
        if known is not None:
            return known
        if own == {"end"}:
            return "word"
        return prior_kind(key, self.lists)

    def is_common(self, word: str) -> bool:
        """Whether a capitalised word is one that is written small elsewhere, and no proper name."""
        small, name = word.lower() in self.small_words(), word in self.inside_capitals()
        if small != name:
            return small
        known = self.corpus.openings.get(word.lower())
        return (self.lists and word.lower() in _STARTERS) if known is None else known

    def is_name(self, word: str) -> bool:
        return word in self.inside_capitals() and word.lower() not in self.small_words()


def prior_kind(key: str, lists: bool = True) -> str:
    """The kind of a word on which neither document nor corpus has evidence: by the lists, then by its form."""
    if lists and key.lower() in TITLES or (len(key) == 1 and key.isupper()):
        return "title"
    if lists and key in MAY_BE_LAST:
        return "either"
    if lists and key in NEVER_LAST or ("." in key and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", key)):
        return "inner"
    return "word"


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


_THAI_GAP = re.compile(r"(?<=[\u0e00-\u0e7f])[ \u00a0]+(?=[\u0e00-\u0e7f“(])")
_ENDS = re.compile(r"[.!?…。！？｡．؟।॥۔‼⁇⁈⁉;][\"'”’“»›」』）)\]】}\s]*$")


def _script(line: str) -> tuple[int, int]:
    """How many letters of scripts without spaces, and how many letters."""
    return (0, sum(map(str.isalpha, line))) if line.isascii() else (len(_UNSPACED.findall(line)), len(_LETTER.findall(line)))


def _unspaced(near: list[str], whole: list[str]) -> bool:
    """Whether a script without spaces prevails in two neighbouring lines, or in the whole text where they have no letter."""
    found = [_script(s) for s in near]
    if not any(map(any, found)):
        found = [_script(s) for s in whole]
    return sum(u for u, _ in found) * 3 > sum(n for _, n in found)


def _blocks(doc: _Document) -> list[tuple[int, int]]:
    """Runs of lines between hard breaks: (start, end) in the text."""
    text = doc.text
    lines = [(a, b) for a, b in _lines(text)]
    stripped = [text[a:b].strip() for a, b in lines]
    if len(lines) == 1:
        return [lines[0]]
    width = max(map(len, stripped))
    ended = [bool(_ENDS.search(s)) for s in stripped]
    inner = any(re.search(r"[.!?…؟।][\"”’»)]*\s", s) for s in stripped)
    caption_like = not any(ended) and not inner
    out, start = [], None
    for i, ((a, b), s) in enumerate(zip(lines, stripped)):
        if not s:
            if start is not None:
                out.append((start, lines[i - 1][1]))
                start = None
            continue
        if start is None:
            start = a
        soft = False
        if i + 1 < len(lines) and stripped[i + 1] and len(s) >= 40 and len(s) >= 0.6 * width and not _unspaced(stripped[i : i + 2], stripped):
            below = stripped[i + 1]
            if ended[i]:
                # a stop at the line's end may be an abbreviation's: what follows decides
                soft = not _ITEM.match(below) and not _LABEL.match(below)
            elif caption_like:
                soft = doc.cased and below[0].islower() and stripped[0][:1].isupper()
            else:
                soft = True
        if not soft:
            out.append((start, b))
            start = None
    if start is not None:
        out.append((start, lines[-1][1]))
    return out


def _word_before(text: str, at: int, least: int) -> str:
    i = at
    while i > least and (text[i - 1].isalnum() or text[i - 1] in ".'’-º" or unicodedata.combining(text[i - 1]) or unicodedata.category(text[i - 1]).startswith("M")):
        i -= 1
    return text[i:at].strip("'’-")


def _opener(text: str, closer: str, start: int, at: int) -> int | None:
    """Where the bracket or quotation that ``closer`` ends was opened since ``start``."""
    if closer in "\"'":
        i = text.rfind(closer, start, at)
        return i if i >= 0 and text.count(closer, start, at) % 2 else None
    opens = _OPEN_FOR.get(closer, "")
    depth = 0
    for i in range(at - 1, start - 1, -1):
        if text[i] == closer:
            depth += 1
        elif text[i] in opens:
            if not depth:
                return i
            depth -= 1
    return None


def _is_boundary(doc: _Document, start: int, run: re.Match, after: int, closers: list[tuple[str, int]], end: int) -> bool:
    text, term = doc.text, run.group()
    begin = run.start()
    nxt = after
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt >= end:
        return True
    spaced = nxt > after
    c = text[nxt]
    wide = any(t in "。！？｡" for t in term) or (not spaced and (_is_cjk(c) or (begin > start and _is_cjk(text[begin - 1]))))
    if set(term) <= set(";\u037e"):
        return doc.greek and spaced and _word_before(text, begin, start)[-1:] >= "Ͱ" and (not doc.cased or not c.islower())
    # hesitation: an ellipsis after a word or two
    if ("…" in term or "..." in term) and begin - start <= 80:
        body = text[start:begin]
        if wide and len(re.sub(r"^.{0,12}[:：]", "", _HEAD.sub("", body, count=1)).strip(" “「")) <= 4:
            return False
        if not doc.cased and not wide and len(body.split()) <= 1 and spaced and not c.isupper() and not doc.upper and not doc.lower:
            return False
    if closers:
        closer, _ = closers[-1]
        opened = _opener(text, closer, start, closers[-1][1])
        heads = opened is not None and not any(ch.isalnum() for ch in _after_head(text, start, opened))
        rest = re.match(r"[^。！？.!?؟।\n]*", text[nxt:nxt + 60]).group()
        if closer in "）)]】}":
            if opened is not None and not heads:
                # a bracket inside a sentence starts none; a stop after it comes later
                if wide or (doc.cased and c.islower()) or not spaced:
                    return False
        elif wide:
            if _TAKES_UP.match(text, nxt) or c in "，、,":
                return False
            if heads and _SAYING.search(re.split(r"[“「『]", rest)[0]) and not _is_kana(rest):
                return False
            return True
        elif heads and not doc.cased and _SAYING.search(" ".join(rest.split()[:5])):
            return False
        elif not (c.isupper() or c.islower()) and c.isalpha() and heads and _SAYING.search(" ".join(rest.split()[:4])):
            return False
        if c in "—–-,،，、;:" or (c in "—–" and spaced):
            return False
    if wide:
        return True
    if not spaced:
        return _is_cjk(c) and not term.startswith(".") and not doc.text[begin - 1 : begin].isascii()
    if c in ",،;:)]}»”" and not closers:
        return False
    file_next = _FILE.match(text, nxt)
    if file_next and not any(ch.isalpha() for ch in file_next.group()):
        file_next = None
    if doc.cased and c.islower() and not file_next:
        return False
    if c in "—–" and closers:
        return False
    if set(term) != {"."} or len(term) > 1:
        return True
    word = _word_before(text, begin, start)
    key = word.lower()
    if not key:
        return True
    if key.isdigit():
        prev = re.search(r"([^\W\d_]+)\s+$", text[max(start, begin - len(word) - 24) : begin - len(word)])
        return not (prev and len(key) <= 2 and c.isalpha() and prev[1].lower() in _BEFORE_ORDINAL and doc.cased)
    kind = doc.kind_of(word)
    if kind == "word" or closers:
        return True
    m = re.match(r"[\"'“„«‹¿¡(\[]*\s?([\w’'-]+)", text[nxt : nxt + 200])
    following = m[1] if m else ""
    capital = following[:1].isupper()
    if kind == "either":
        return bool(file_next) or not doc.is_name(following)
    initial = len(word) == 1 and word.isupper()
    if kind == "title":
        return initial and len(following) > 1 and c.isupper() and text[nxt + 1 : nxt + 2] != "." and doc.cased and doc.is_common(following) and following.lower() in doc.small_words()
    # a unit after a number may end a sentence, an abbreviation before one does not
    if word.islower() and text[max(start, begin - len(word) - 8) : begin - len(word)].rstrip()[-1:].isdigit() and (len(key) == 1 or capital):
        return True
    return bool(file_next) or (capital and doc.cased and doc.is_common(following))


# Words that often open a sentence and are no proper names; the last prior.
_STARTERS = frozenset(
    """now the a an this that these those it he she they we you i there here in on at by for from to of as if when while after before
    our my his her their its each every some any no not but and or so then what who why how where did does do is are was were please
    der die das ein eine es er sie wir ich und aber dann wenn als nach vor im am le la les un une il elle nous on ce cette et mais
    el los las una lo y pero en он она они мы и но а в на это ο η το οι τα και""".split()
)


def _is_kana(s: str) -> bool:
    return any("぀" <= c <= "ヿ" for c in s)


def _after_head(text: str, start: int, at: int) -> str:
    """What stands between the sentence's start and ``at`` beside numbering, bullets and a speaker label."""
    s = text[start:at]
    if m := _HEAD.match(s):
        s = s[m.end():]
    if (m := re.match(r"\s*[^\W\d_][\w.'’ -]{0,30}\s?[:：]\s*$", s)) and not _SAYING.search(s):
        s = s[m.end():]
    return s


_NOTHING = Corpus()


def sentence_starts(text: str | None, corpus: Corpus = _NOTHING, lists: bool = True) -> list[int]:
    """The position of the first character of every sentence."""
    if not text or not any(c.isalnum() or unicodedata.category(c)[0] in "PSLNM" for c in text):
        return []
    doc, out = _Document(text, corpus, lists), []
    for start, end in _blocks(doc):
        for s, e in _in_block(doc, start, end):
            if any(unicodedata.category(ch)[0] not in "ZC" for ch in text[s:e]):
                out.append(s)
    return out


def _in_block(doc: _Document, start: int, end: int) -> Iterator[tuple[int, int]]:
    text = doc.text

    def skip(i: int) -> int:
        while i < end and text[i].isspace():
            i += 1
        return i

    at = first = skip(start)
    head = _HEAD.match(text, first, end)
    scan = head.end() if head else first
    if at >= end:
        return
    marks = [(m.start(), m) for m in _TERM.finditer(text, scan, end)]
    thai = [(m.start(), m) for m in _THAI_GAP.finditer(text, scan, end)]
    marks = sorted(marks + thai, key=lambda x: x[0])
    for pos, m in marks:
        if pos < at:
            continue
        if m.group()[0].isspace():
            yield at, pos
            at = skip(m.end())
            continue
        after, closers = m.end(), []
        while after < end:
            c = text[after]
            if c in _CLOSERS or (c == "“" and _opener(text, "“", at, after) is not None):
                if c in "\"'" and _opener(text, c, at, after) is None:
                    break
                closers.append((c, after))
                after += 1
            elif c in " \u00a0\u202f\u2009" and after + 1 < end and text[after + 1] == "»" and _opener(text, "»", at, after + 1) is not None:
                closers.append(("»", after + 1))
                after += 2
            elif c in "!?.…" and closers:
                after += 1
            else:
                break
        if _is_boundary(doc, at, m, after, closers, end):
            yield at, after
            at = skip(after)
    if at < end:
        yield at, end


# ---- the corpus ---------------------------------------------------------------------------------------------------

_KINDS = ("inside", "end", "capital", "digit", "other")
_FIELDS = (*_KINDS, "tokens", "small", "names", "openings", "followers")


def _evidence(texts: list[str | None]) -> dict[str, list[int]]:
    """Counts by word: its stops by kind, all its occurrences, those in small letters, capitalised inside sentences, at openings;
    and 64 bits, of which each different word that follows a stop sets one."""
    tokens: Counter = Counter()
    names: Counter = Counter()
    openings: Counter = Counter()
    stops: Counter = Counter()
    for t in texts:
        if not t or (t.upper() != t.lower() and t in (t.lower(), t.upper())):
            continue
        tokens.update(_TOKEN.findall(t))
        names.update(_INSIDE.findall(t))
        openings.update(_OPENING.findall(t))
        stops.update(stop_kinds(t))
    out: dict[str, list[int]] = {}
    at = {f: i for i, f in enumerate(_FIELDS)}

    def add(word: str, field: str, n: int) -> None:
        out.setdefault(word, [0] * len(_FIELDS))[at[field]] += n

    for w, n in tokens.items():
        add(_key(w), "tokens", n)
        if w.islower():
            add(_key(w), "small", n)
    for w, n in names.items():
        add(w.lower(), "names", n)
    for w, n in openings.items():
        add(w.lower(), "openings", n)
    for (w, k, following), n in stops.items():
        add(w, k, n)
        if k not in ("inside", "end"):
            out[w][at["followers"]] |= 1 << (zlib.crc32(following.encode()) & 63)
    for row in out.values():
        row[-1] -= (row[-1] >> 63) << 64  # as a signed number
    return out


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(word, inside, end, capital, digit, other, tokens, small, names, openings) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _evidence(b.column(0).to_pylist())
            columns = list(zip(*got.values())) if got else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(got), pa.string()), *[pa.array(list(c), pa.int64()) for c in columns]], names=["word", *_FIELDS]
            )

    counts = documents.select("text").mapInArrow(run, "word string, " + ", ".join(f"{f} long" for f in _FIELDS))
    return counts.groupBy("word").agg(*[F.sum(f).alias(f) for f in _FIELDS[:-1]], F.bit_or("followers").alias("followers"))


def corpus_kinds(counts: DataFrame, ends: float) -> DataFrame:
    """(word, kind, stops): what the counts say about a word before stops; ``ends`` is the share of all stops at ends of paragraphs.

    An abbreviation meets at most a fifth of the ends that its stops let expect, where that
    expectation is high enough to be met by chance in one case of twenty (three ends), or
    for longer words of a thousand (seven), and hardly occurs without its stop; at least two different words follow it, so
    that copies of one text prove nothing. A word that
    meets its share of ends is none; where neither holds the counts say nothing.
    """
    stops = sum((F.col(k) for k in _KINDS), F.lit(0))
    expected = stops * F.lit(ends)
    few = F.col("end") <= 0.2 * expected
    rarely_bare = F.col("tokens") - stops <= 0.25 * stops
    varied = F.bit_count("followers") >= 2
    sure = few & varied & ((rarely_bare & (expected >= F.when(F.length("word") > 4, 7.0).otherwise(3.0))) | (expected >= 12.0))
    inside = (F.col("inside") >= 3) & (F.col("inside") >= 0.2 * stops)
    kind = (
        F.when(sure & (F.col("capital") + F.col("other") >= 0.5 * stops), "title").when(sure, "inner")
        .when(inside & few, "inner").when(inside, "either").when((expected >= 3.0) & (F.col("end") > 0.4 * expected), "word")
    )
    return counts.select("word", kind.alias("kind"), stops.alias("stops")).where("kind is not null")


def corpus_of(documents: DataFrame) -> Corpus:
    """The words with a share of all stops of at least ``STOP_SHARE``, or of all openings of at least ``START_SHARE``."""
    counts = checkpointed(corpus_counts(documents))
    stops = sum((F.sum(k) for k in _KINDS), F.lit(0))
    total = counts.agg(stops.alias("stops"), F.sum("end").alias("end"), F.sum("openings").alias("openings")).first()
    if not total["stops"] and not total["openings"]:
        return _NOTHING
    kinds = corpus_kinds(counts, max(0.01, (total["end"] or 0) / max(1, total["stops"]))).where(F.col("stops") >= STOP_SHARE * total["stops"])
    # at most 50,000 words by the share; those that say what the form says anyway are left out
    plain = (F.col("kind") == "word") & (F.length("word") > 1) & ~F.col("word").contains(".") & ~F.col("word").isin(*sorted(NEVER_LAST | MAY_BE_LAST))
    told = {r["word"]: r["kind"] for r in kinds.where(~plain).select("word", "kind").collect()}
    often = counts.where(F.col("openings") >= F.greatest(F.lit(2.0), F.lit(START_SHARE * total["openings"])))
    openings = {r["word"]: r["common"] for r in often.select("word", (F.col("small") > F.col("names")).alias("common")).collect()}
    return Corpus(told, openings)


def _starts_batch(ids: pa.Array, texts: list, corpus: Corpus, lists: bool) -> pa.RecordBatch:
    doc_ids, starts, ends, numbers = [], [], [], []
    for d, t in zip(ids.to_pylist(), texts):
        got = sentence_starts(t, corpus, lists)
        doc_ids.extend([d] * len(got))
        starts.extend(got)
        numbers.extend(range(len(got)))
        ends.extend(s for s in [*got[1:], len(t or "")] if got)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
        names=["doc_id", "number", "start_char", "next_char"],
    )


def sentences(documents: DataFrame, corpus: Corpus | None = None, lists: bool = True) -> DataFrame:
    """(doc_id, number, start_char, next_char): the sentences of each document in order with their place.

    ``corpus`` is counted from the documents unless it is given; ``lists`` False leaves out the lists of abbreviations.
    """
    docs = spread(documents.select(F.col("doc_id").cast("long"), "text").where("text is not null"))
    corpus = corpus_of(docs) if corpus is None else corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _starts_batch(b.column(0), b.column(1).to_pylist(), corpus, lists)

    return docs.mapInArrow(run, "doc_id long, number int, start_char long, next_char long")
