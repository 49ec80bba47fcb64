"""Texts of the publishing system left in documents: unfilled slots, filler, error pages, script notices.

Three routes, each over all documents:

1. *aligned*: stretches that carry signs prose does not use are lined up by the words around them
   (before, on both sides, or the whole segment). A frame whose stretches vary between documents is a
   slot; a name is a variable if it mostly stands in such frames (a stenographer's bracket stands anywhere). Slots that
   retain a variable's name are flagged, and so are the same templates with a default or nothing in the slot.
2. *template*: segments that recur up to their numbers and codes, that occur mostly in documents made up of
   such segments only (a procedural formula stands in speeches), and whose words speeches do not
   use, are templates of error pages, notices and filler. Documents that hold one as a whole segment are flagged.
3. *pattern*: the syntax of template languages, and wording of fixed lists, as seeds for what does not recur. A
   notice must make up a segment from its start to its end (after a speaker's name): wording that a
   speaker mentions or quotes stands inside a longer sentence or in quotation marks.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countlake.session import cut, small, spread

#: A frame is a slot if so many names stand in it, in so many documents.
SLOT_NAMES, SLOT_DOCUMENTS = 2, 3
#: Share of a variable's documents in which it stands in a slot.
NAME_SHARE = 0.5
#: Documents that must share a template; share of them that must consist of such templates only; share of its words
#: that must be foreign. A word is foreign if at least FOREIGN of its documents hold it in such templates.
PAGE_DOCUMENTS, PAGE_SHARE, PAGE_FOREIGN, FOREIGN = 3, 0.5, 0.2, 0.5

#: How template languages and editors write a slot.
SLOTS = [
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^{}\n]+%\}",
    r"\$\{[^{}\n]+\}",
    r"<%[^<>\n]+%>",
    r"<\?(?:=|php)[^<>\n]+\?>",
    r"%\(\w+\)[sdif]",
    r"(?<![\w%])%[^\W\d]\w{2,}%(?![\w%])",
    r"\[\[[^\[\]\n]+\]\]",
    r"@@\w[\w .'’-]*@@",
    r"(?<!\w)#[^\W\d]\w{2,}#(?!\w)",
    r"(?<!\w)__[^\W\d_]\w*?__(?!\w)",
    r"(?<!\w)XX [^\W\d][\w'’ -]+ XX(?!\w)",
    r"<(?!(?:BR|HR|DIV|SPAN|STRONG|BODY|HTML|HEAD|TABLE|LI|UL|OL|TD|TR|TH|EM|P|B|I|A|H\d)>)[A-ZÀ-Þ][A-ZÀ-Þ0-9_]{2,}>",
    r"\{\d{1,2}\}",
    r"\{[a-z][a-z0-9_.]+\}",
    r"\[(?i:insert|enter|your|fill in|hier einfügen|einfügen|bitte einfügen|insérer|à insérer|à compléter|compléter)\b[^\[\]\n]*\]",
]
#: Words in the place of a slot's value.
DEFAULTS = ["n/a", "tbd", "tba", "null", "none", "nil", "undefined", "nan", "unknown", "untitled", "k. a.", "n. n.", "???"]
#: Beginnings of the usual filler vocabulary, and key mash.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum vivamus mauris".split()
MASH = r"(?:\b(?:asdf\w*|qwert\w*|azerty|yxcv\w*|zxcv\w*|jkl\w?|hjkl|fdsa|sdfg\w*|uiop)\b[\s.,]*){3,}"
REPEATED = r"\b(text|test|texte|blindtext|dummy|filler|placeholder|platzhalter|foo|bar|bla|blah|xxx+)\b(?:[\s.,]+(?:\d+[\s.,]+)?\1\b){2,}|\b(texte d['’]exemple|sample text|beispieltext|mustertext|dummy text)\b(?:[\s.,]+\2\b)+"

#: Whole segments, in English, German and French. Each must span the segment.
_CODE = r"(?:\s*\((?:code|réf|ref|kode)?\.?\s*[\w-]+\))?"
FILLER = [
    r"(?:(?:body|title|main|your)\s)?(?:text|copy|content|title|headline)\s(?:goes|comes)\shere",
    r"(?:this\sis\s(?:a\s)?)?placeholder(?:\s(?:copy|text|page|content|paragraph))?(?:[,;]?\s(?:please\s)?(?:replace|remove|delete)\b.{0,40})?",
    r"(?:this\sis\s(?:a\s)?)?(?:sample|dummy|example)\s(?:paragraph|text|copy|content|page)(?:\s(?:to|for)\b.{0,40})?",
    r"(?:content|text|page|transcript|more)\s(?:is\s)?(?:coming\ssoon|to\s(?:follow|come))", r"coming\ssoon", r"(?:please\s)?insert\s(?:text|name|title|content)(?:\shere)?",
    r"(?:contenu|texte)\sà\s(?:venir|compléter|insérer|suivre)", r"paragraphe\sfictif(?:\spour\b.{0,40})?", r"(?:faux|fau)\s?texte.{0,20}", r"(?:le\s)?texte\s(?:viendra|ira|apparaîtra)\sici", r"texte\sd['’]exemple",
    r"(?:blindtext\s?)+", r"(?:hier\s(?:steht|folgt|kommt|erscheint)\s(?:später|bald|demnächst|in\skürze|noch)\b.{0,40})", r"(?:mustertext|beispieltext|platzhalter(?:text)?)(?:\s(?:zur|für|zum|bitte)\b.{0,40})?", r"(?:inhalt|text|beitrag)\sfolgt(?:\s.{0,20})?",
]
_THING = r"(?:page|document|transcript|record|speech|file|site|resource|report|content)"
ERRORS = [
    r"(?:http\s)?(?:error\s)?[345]\d\d\b[\s:,.–-]*(?:error\s)?(?:not\sfound|page\snot\sfound|forbidden|(?:access\s)?denied|bad\sgateway|(?:internal\s)?server\serror|(?:service\s)?unavailable|gateway\stime-?out|unauthori[sz]ed|bad\srequest|too\smany\srequests)",
    r"error\s?[345]\d\d(?:\s?[:–-].{0,60})?", r"bad\sgateway", r"(?:the\s)?(?:requested\s)?" + _THING + r"\s(?:was\s|could\s)?not\s(?:be\s)?found", r"(?:internal\s)?server\serror" + _CODE, r"service\s(?:is\s)?(?:temporarily\s|currently\s)?unavailable" + _CODE, r"access\s(?:is\s)?denied" + _CODE,
    r"(?:the\s)?(?:gateway|server|upstream|host)\sdid\snot\s(?:answer|respond|reply)(?:\sin\stime)?", r"(?:upstream|status|host|trace|request)=\S+(?:\s\w+=\S+)*", r"too\smany\srequests(?:\sfrom\b.{0,40})?", r"(?:please\s)?wait\s\d+\s(?:seconds|minutes)\b.{0,40}",
    r"(?:we(?:['’]re|\sare)\s)?sorry,?\s(?:but\s)?something\swent\swrong\b.{0,60}", r"something\swent\swrong\b.{0,40}", r"(?:request|error|trace|incident)\sid\s?:\s?[\w-]+", r"reference\s(?:no\.?\s)?(?=\w*\d)[\w-]{6,}", r"an?\s(?:unexpected\s|internal\s|unknown\s)?error\s(?:has\s)?occurred\b.{0,40}",
    r"please\s(?:try\sagain|retry|come\sback)\s(?:later|in\s\d+\s\w+)\b.{0,50}", r"your\ssession\s(?:has\s)?(?:timed\sout|expired)\b.{0,50}", r"(?:please\s)?(?:sign|log)\sin\sagain\b.{0,50}", r"this\s" + _THING + r"\s(?:has\sbeen\s(?:moved|removed|deleted)|no\slonger\sexists|has\smoved)\b.{0,50}", r"return\sto\sthe\s(?:list|home|start|index|overview)\b.{0,40}",
    r"the\s" + _THING + r"\s(?:that\s)?you\s(?:asked\sfor|requested|are\slooking\sfor)\s(?:could\snot\sbe|cannot\sbe|was\snot|does\snot)\b.{0,40}", r"traceback\b.*", r"\w+\sin\s\w+\sline\s\d+\b.*", r"[a-z]\w*(?:\.\w+)+(?:exception|error)\b.*", r"at\s[\w.$]+\([\w.]+:\d+\)", r"(?:fatal|uncaught|unhandled)\s(?:error|exception)\b.*", r"field\s['\"‘’]\w+['\"‘’]\sis\smissing",
    r"(?:cette\s)?page\s(?:est\s)?(?:introuvable|non\strouvée)", r"erreur\s?[345]\d\d(?:\s?[:–-].{0,60})?", r"erreur\s(?:interne|du\sserveur|inattendue)\b.{0,40}", r"accès\s(?:refusé|interdit|non\sautorisé)" + _CODE, r"(?:le\s)?service\s(?:est\s)?(?:momentanément\s|temporairement\s)?indisponible\b.{0,50}", r"votre\ssession\s(?:a\s|est\s)?expiré\b.{0,50}", r"trop\sde\s(?:requêtes|demandes)\b.{0,40}",
    r"(?:le|la)\s(?:compte\srendu|page|document|texte)\sn['’](?:a\spas\spu\sêtre|est\spas|existe)\b.{0,40}", r"une\serreur\b.{0,30}(?:s['’]est\sproduite|est\ssurvenue)\b.{0,30}", r"retour\sà\s(?:la\sliste|l['’]accueil)\b.{0,30}", r"veuillez\s(?:réessayer|patienter|vous\sreconnecter)\b.{0,50}", r"(?:référence|incident|dossier)\s(?=\w*\d)[\w-]{6,}",
    r"fehler\s?[345]\d\d(?:\s?[:–-].{0,60})?", r"zugriff\s(?:wurde\s)?verweigert" + _CODE, r"(?:die\s)?(?:angeforderte\s)?seite\s(?:wurde\s|konnte\s)?nicht\sgefunden(?:\swerden)?", r"das\s(?:protokoll|dokument|video)\skonnte\snicht\b.{0,40}", r"zu\sviele\sanfragen\b.{0,40}", r"(?:bitte\s)?versuchen\ssie\ses\s(?:bitte\s)?(?:in\s\d+\s\w+|später)\b.{0,40}", r"ihre\ssitzung\sist\sabgelaufen\b.{0,60}", r"(?:interner\s)?serverfehler\b.{0,20}", r"(?:der\s)?dienst\s(?:ist\s)?(?:vorübergehend\s|derzeit\s)?nicht\sverfügbar\b.{0,40}", r"zurück\szur\s(?:übersicht|startseite|liste)\b.{0,30}", r"(?:es\sist\s)?ein\s(?:interner\s|unerwarteter\s)?fehler\s(?:ist\s)?aufgetreten\b.{0,30}", r"vorgang\s(?=\w*\d)[\w-]{6,}",
]
_SCRIPT = r"(?:java\s?script|scripts?|scripting|cookies?)"
SCRIPTS = [
    r"(?:please\s)?(?:activate|enable|turn\son|switch\son|allow)\s(?:(?:your\s)?browser['’]?s?\s)?" + _SCRIPT + r"(?:\s(?:and|or)\s" + _SCRIPT + r")?(?:\s(?:in|to|for|and\s(?:reload|refresh|try))\b.{0,60})?",
    r"(?:you|this\s(?:page|site|viewer|app|application|document))\s(?:need|needs|require|requires|must)\b[^.!?]{0,30}\b" + _SCRIPT + r"\b.{0,60}", _SCRIPT + r"(?:\s(?:and|or)\s" + _SCRIPT + r")?\s(?:must\sbe|is|are|has\sto\sbe|have\sto\sbe)\s(?:allowed|enabled|required|disabled|switched\so\w+|turned\so\w+|needed)\b.{0,40}",
    r"your\sbrowser\s(?:does\snot|doesn['’]t|cannot|has)\b.{0,100}", r"checking\syour\sbrowser\b.{0,60}", r"scripting\sis\s(?:switched|turned)\soff",
    r"(?:veuillez|merci\sd['’])\s?activer\s(?:les\s|le\s)?" + _SCRIPT + r"\b.{0,60}", r"les\scookies?\b.{0,30}doivent\sêtre\s(?:autorisés|activés|acceptés)", r"(?:cette|la)\spage\s(?:nécessite|requiert|exige)\b.{0,30}" + _SCRIPT + r"\b.{0,50}", r"votre\snavigateur\s(?:ne|n['’]|a|les)\b.{0,60}", r"(?:java\s?script|les\s(?:scripts|cookies))\s(?:est|sont|doit|doivent)\b.{0,40}",
    r"bitte\s(?:aktivieren|erlauben|schalten)\ssie\s(?:\w+\s)?(?:java\s?script|skripte|cookies)\b.{0,60}", r"(?:cookies|java\s?script|skripte)(?:\sund\s(?:cookies|java\s?script|skripte))?\s(?:müssen|muss|ist|sind)\b.{0,40}", r"diese\s(?:seite|anwendung)\s(?:benötigt|erfordert|braucht)\b.{0,20}(?:java\s?script|skripte|cookies)\b.{0,40}", r"ihr\sbrowser\s(?:hat|unterstützt|kann|blockiert)\b.{0,60}",
]
_SEGMENT = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?]['\"»”’)]))\s+|[\r\n  \u0085]+")
_SPEAKER = re.compile(r"^(?:[—–-]\s*)?(?:(?:[A-ZÀ-Þ][\w.'’-]*,?\s+){0,3}[A-ZÀ-Þ][\w.'’-]*)\s*(?:\([^()]{0,60}\))?\s?:\s+")
_LEAD = re.compile(r"^(?:[—–*•>-]\s*)+")
_BULLET = re.compile(r"^(?:[—–•>-]\s*|\*\s+)+")
_slot = re.compile("|".join(f"(?:{p})" for p in SLOTS))
_notice = {k: re.compile("(?:" + "|".join(f"(?:{p})" for p in v) + r")\s*[.!…:,;]*", re.I) for k, v in {"filler": FILLER, "error": ERRORS, "script": SCRIPTS}.items()}
_mash, _repeat = re.compile(MASH, re.I), re.compile(REPEATED, re.I)
_word = re.compile(r"[^\W\d_]+")
_default = re.compile(r"(?<![\w/])(?:" + "|".join(re.escape(d) for d in DEFAULTS) + r")(?![\w/])|\[\s*\]", re.I)
_QUOTES = "'\"«»„“”‚‘’‹›"
#: Signs that prose does not use around a word, and stretches that carry them.
_S = r"{}<>\[\]%$@#~^*\\"
_marked = re.compile(
    r"%\(\w+\)\w?"
    rf"|[{_S}]+[^{_S}\n]+[{_S}]+(?:\w(?!\w))?"
    rf"|[$@#%~]+[^\W\d_]\w*"
    r"|(?<!\w)_*[^\W_]+_\w*|(?<!\w)_+\w*"
    r"|\b([A-Z])\1+\s(?:[^\W\d][\w'’-]*\s)+?\1\1+\b|\b([A-Z])\2{2,}\b"
)
_any_mark = re.compile(rf"[{_S}_]|([A-Z])\1")
#: What mashed keys, repeated words and defaults have somewhere, in lower case: a cheap test before the patterns.
_MASHED = ["asdf", "qwert", "azerty", "yxcv", "zxcv", "jkl", "fdsa", "sdfg", "uiop"]
_REPEATING = ["text", "test", "dummy", "filler", "placeholder", "platzhalter", "foo", "bar", "bla", "xxx"]
_DEFAULTING = [*DEFAULTS, "["]
_paren = re.compile(r"\([^()]*\)")
_token = re.compile(r"[^\W_]+|\*")
_twice = re.compile(r"(.)\1+")
_head = re.compile(r"^(?:[A-ZÀ-Þ][\w.'’-]*,?\s+){0,3}[A-ZÀ-Þ][\w.'’-]*\s*(?:\([^()]*\)|\[[^\[\]]*\])?\s*:(?:\s+|$)")


def _latin(word: str) -> bool:
    """A word of the filler vocabulary, whole, cut, lengthened or with one letter changed."""
    if len(word) < 4:
        return word in _short_latin
    return word[:4] in _latin_stems or (word[1:4], len(word)) in _latin_tails or word[:3] + "*" in _latin_stems and len(word) <= 5


_short_latin = {w for w in LATIN if len(w) < 4}
_latin_stems = {w[:4] for w in LATIN if len(w) > 3} | {w[:3] + "*" for w in LATIN if 3 <= len(w) <= 5}
_latin_tails = {(w[1:4], len(w)) for w in LATIN if len(w) > 3}


class _Known(dict):
    """What is known of words; forgotten when there are too many."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = _latin(word)
        return got


_latin_known = _Known()


def latin_filler(words: list[str], run: int = 10, share: float = 0.75) -> bool:
    """A stretch of ``run`` words of which at least ``share`` are of the filler vocabulary."""
    if len(words) < 5:
        return False
    run = min(run, len(words))
    hits = [_latin_known[w] for w in words]
    if sum(hits) < share * run:
        return False
    now = sum(hits[:run])
    for i in range(run, len(hits) + 1):
        if now >= share * run and len(set(words[i - run : i])) > 1:
            return True
        if i < len(hits):
            now += hits[i] - hits[i - run]
    return False


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _tokens(text: str) -> list[str]:
    """Words without case, signs and parentheses; a word with a digit is 0."""
    if "(" in text:
        text = _paren.sub(" ", text)
    return [w if w.isalpha() or w == "*" else "0" for w in _token.findall(text.lower())]


def _name(stretch: str) -> str:
    """What a marked stretch says: its words, or its signs and digits if it has no words."""
    words = [w for w in _word.findall(stretch.lower()) if not _twice.fullmatch(w)]
    return " ".join(words) or re.sub(r"\d+", "0", stretch)


def frames(segment: str, start: int, end: int) -> list[tuple[str, str | None]]:
    """(frame, whole segment without the stretch or None) of segment[start:end]: the three words before it, two
    before and two behind, and the whole segment. Other marked stretches are alike; a frame has two words at least."""
    left = ["^", *_tokens(re.sub(r"\([^()]*$", " ", _marked.sub(" * ", segment[:start].replace("*", " "))))]
    right = [*_tokens(re.sub(r"^[^()]*\)", " ", _marked.sub(" * ", segment[end:].replace("*", " ")))), "$"]
    real = lambda ws: sum(w not in "^$*0" for w in ws)
    out: list[tuple[str, str | None]] = []
    if len(left) > 1 and len(right) > 1 and real(left[-2:] + right[:2]) >= 2:
        out.append((" ".join(["both", *left[-2:], "_", *right[:2]]), None))
    if real(left[-3:]) >= 2:
        out.append((" ".join(["before", *left[-3:]]), None))
    if real(left + right) >= 2:
        out.append((" ".join(["whole", *left, "_", *right]), " ".join(left[1:] + right[:-1])))
    return out


class Reader:
    """What a text consists of. Segments are remembered, since many recur."""

    def __init__(self, patterns: bool = True, remember: int = 200_000):
        self.patterns, self.remember, self.known = patterns, remember, {}

    def segments(self, text: str) -> Iterator[str]:
        for raw in _SEGMENT.split(text):
            segment = raw.strip()
            if segment:
                yield segment

    def bare(self, segment: str) -> str:
        return _head.sub("", _BULLET.sub("", segment))

    def wording(self, segment: str) -> list[str]:
        """Kinds of wording from the fixed lists that make up the segment, and of template syntax in it."""
        out = []
        if _any_mark.search(segment):
            for m in _slot.finditer(segment):
                if not _quoted(segment, m.start(), m.end()):
                    out.append("slot")
        bare = _LEAD.sub("", segment)
        for part in {bare, _SPEAKER.sub("", segment)}:
            out += [k for k, p in _notice.items() if p.fullmatch(part)]
        low = segment.lower()
        mashed = any(w in low for w in _MASHED) and _mash.search(segment)
        if mashed or any(w in low for w in _REPEATING) and _repeat.search(segment) or latin_filler(_word.findall(low)):
            out.append("filler")
        return out

    def read(self, segment: str) -> tuple:
        """(key, words, has a word in lower case, kinds by pattern, marked stretches, defaults) of a segment."""
        got = self.known.get(segment)
        if got is None:
            plain = html.unescape(segment) if "&" in segment else segment
            bare = self.bare(plain)
            words = _tokens(bare)
            marked, blanks = [], []
            if _any_mark.search(bare):
                for m in _marked.finditer(bare):
                    if not _quoted(bare, m.start(), m.end()):
                        marked.append((_name(m.group()), frames(bare, m.start(), m.end())))
            low = bare.lower()
            for m in _default.finditer(bare) if any(w in low for w in _DEFAULTING) else ():
                blanks += [f for f, _ in frames(bare, m.start(), m.end()) if not f.startswith("before")]
            lower = any(w[0].islower() for w in _word.findall(bare))
            got = (_key(" ".join(words)) if words else None, frozenset(words), lower, self.wording(segment) if self.patterns else [], marked, blanks)
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[segment] = got
        return got


def _quoted(segment: str, start: int, end: int) -> bool:
    return bool(start and end < len(segment) and segment[start - 1] in _QUOTES and segment[end] in _QUOTES)


_HITS = "doc_id long, row string, key long, name string, number long, empty long"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=["doc_id", "row", "key", "name", "number", "empty"])


def _scan(patterns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(patterns)
        for batch in batches:
            rows: set[tuple] = set()
            df: Counter = Counter()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text or text.isspace():
                    continue
                segments, words = {}, set()
                for at, segment in enumerate(reader.segments(text)):
                    key, own, lower, kinds, marked, blanks = reader.read(segment)
                    words |= own
                    if key is not None:
                        segments[key] = lower
                    rows.update((doc, "pattern", None, k, None, None) for k in kinds)
                    for n, (name, around) in enumerate(marked):
                        rows.update((doc, "marked", _key(f), name, at * 1000 + n, e and _key(e)) for f, e in around)
                    rows.update((doc, "default", _key(f), None, None, None) for f in blanks)
                rows.update((doc, "segment", k, None, len(segments), int(lower)) for k, lower in segments.items())
                df.update(words)
            yield _record([*rows, *((None, "word", None, w, n, None) for w, n in df.items())])

    return run


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word) of all segments of some texts."""
    reader = Reader(False)
    for batch in batches:
        rows = {(key, w) for text in batch.column("text").to_pylist() for s in reader.segments(text) for key, words, *_ in [reader.read(s)] for w in words - {"0"}}
        cols = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["key", "word"])


def aligned_slots(hits: DataFrame) -> DataFrame:
    """(doc_id, kind) of slots that retain a variable's name, a default or nothing, from the rows of a scan.

    Everything is counted by aggregates with partial sums; the tables of frames and names are broadcast only when measured to be small.
    """
    marked = hits.where("row = 'marked'").select("doc_id", "key", "name", "empty")
    stood = marked.select("key", "name", "empty", "doc_id").distinct().groupBy("key", "name").agg(F.count("*").alias("docs"), F.max("empty").alias("empty"))
    several = stood.groupBy("key").agg(F.count("*").alias("names"), F.sum("docs").alias("docs"), F.max("empty").alias("empty"))
    several = cut(several.where((F.col("names") >= SLOT_NAMES) & (F.col("docs") >= SLOT_DOCUMENTS)).select("key", "docs", "empty"), "residue-frames")
    # documents that hold the whole segment with nothing in the place
    bare = several.where("empty is not null").groupBy(F.col("empty").alias("bare")).agg(F.max("docs").alias("docs"))
    empty = cut(hits.where("row = 'segment'").select("doc_id", F.col("key").alias("bare")).join(small(bare), "bare").distinct(), "residue-empty")
    # where that is the commoner sentence, the stretch is set into it and fills no slot
    common = empty.groupBy("bare", "docs").agg(F.count("*").alias("n")).where("n >= docs").select(F.col("bare").alias("empty"))
    several = cut(several.join(small(common), "empty", "left_anti").select("key", "empty"), "residue-frames")
    total = marked.select("name", "doc_id").distinct().groupBy("name").agg(F.count("*").alias("total"))
    framed = marked.drop("empty").join(small(several), "key")
    inside = framed.select("name", "doc_id").distinct().groupBy("name").agg(F.count("*").alias("inside"))
    names = cut(total.join(inside, "name").where(F.col("inside") >= NAME_SHARE * F.col("total")).select("name"), "residue-names")
    variable = framed.join(small(names), "name", "left_semi")
    slots = cut(variable.groupBy("key", "empty").agg(F.count_distinct("name").alias("names")).where(F.col("names") >= SLOT_NAMES).select("key", "empty"), "residue-slots")
    is_slot = small(slots.select("key"))
    retained = variable.join(is_slot, "key", "left_semi").select("doc_id", F.lit("slot").alias("kind"))
    default = hits.where("row = 'default'").join(is_slot, "key", "left_semi").select("doc_id", F.lit("blank").alias("kind"))
    nothing = empty.join(small(slots.select(F.col("empty").alias("bare")).distinct()), "bare", "left_semi").select("doc_id", F.lit("blank").alias("kind"))
    return retained.unionByName(default).unionByName(nothing).distinct()


def page_templates(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, kind) of documents that hold a template of an error page, a notice or filler as a segment."""
    seg = hits.where("row = 'segment'").select("doc_id", "key", F.col("number").alias("segments"), F.col("empty").alias("lower")).distinct()
    often = cut(seg.groupBy("key").agg(F.count("*").alias("docs"), F.max("lower").alias("lower")).where(F.col("docs") >= PAGE_DOCUMENTS), "residue-often")
    held = cut(seg.join(small(often), "key").select("doc_id", "key", "segments", "docs", often["lower"]), "residue-held")
    pages = held.groupBy("doc_id", "segments").agg(F.count("*").alias("n")).where("n = segments").select("doc_id")
    whole = held.join(pages, "doc_id", "left_semi").groupBy("key", "docs", "lower").agg(F.count("*").alias("pages"), F.min("doc_id").alias("example"))
    whole = cut(whole.where((F.col("pages") >= PAGE_SHARE * F.col("docs")) & (F.col("lower") > 0)).select("key", "example"), "residue-whole")
    example = texts.join(small(whole.select(F.col("example").alias("doc_id")).distinct()), "doc_id", "left_semi")
    words = cut(example.mapInArrow(_examples, "key long, word string").join(small(whole.select("key")), "key", "left_semi").distinct(), "residue-words")
    where = held.select("doc_id", "key").join(small(whole.select("key")), "key", "left_semi")
    own = where.join(small(words), "key").select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("own"))
    df = hits.where("row = 'word'").groupBy(F.col("name").alias("word")).agg(F.sum("number").alias("docs"))
    foreign = own.join(df, "word").select("word", (F.col("own") >= FOREIGN * F.col("docs")).cast("double").alias("foreign"))
    strange = words.join(foreign, "word", "left").groupBy("key").agg(F.avg(F.coalesce("foreign", F.lit(0.0))).alias("share")).where(F.col("share") >= PAGE_FOREIGN).select("key")
    return where.join(small(strange), "key", "left_semi").select("doc_id", F.lit("page").alias("kind")).distinct()


def residue(documents: DataFrame, patterns: bool = True) -> DataFrame:
    """(doc_id, kind, route): documents with text the publishing system left, of which kinds, found by which routes.

    kind is slot or blank (route aligned), page (route template), slot, filler, error or script (route pattern).
    patterns=False leaves the fixed lists out. Null ids, null, empty and blank texts give nothing, repeated rows
    of a document count once; other columns are ignored. Texts are read whole and are not shuffled, only 64-bit keys of
    their segments are; templates are counted over all documents.
    """
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = cut(spread(texts).mapInArrow(_scan(patterns), _HITS), "residue-hits")
    plain = hits.where("row = 'pattern'").select("doc_id", F.col("name").alias("kind"), F.lit("pattern").alias("route"))
    slots = aligned_slots(hits).withColumn("route", F.lit("aligned"))
    pages = page_templates(hits, texts).withColumn("route", F.lit("template"))
    return plain.unionByName(slots).unionByName(pages).distinct()
