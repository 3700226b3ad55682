"""Sentence boundaries by cascading tables of break / no-break rules.

A rule is (breaks, before, after): two regular expressions that must match the text that ends at a
position and the text that follows it.  The tables of a language are consulted in order (protected
spans, markers, language abbreviations, script-wide rules) and the first matching rule decides the
position.  Positions are offered only where the script's end marks stand, at blank lines, and in scripts
without end marks at white space.

Defined results: NULL, empty and all-blank texts have no sentence.  A sentence starts at its first
character that is not white space; a paragraph or list marker belongs to the sentence it opens; closing
quotes belong to the sentence they close; nothing inside a quotation is split off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.session import spread

#: Words before a position that the rules may look at; a window holds so many at least, or the whole sentence.
WORDS_BACK, WINDOW = 6, 48

# Abbreviations that never end a sentence, per language ("" holds for all of them).
ABBREVIATIONS = {
    "": "Dr Prof Mr Mrs Ms St No Nos Art Arts cf approx vs fn sec p pp e.g i.e dept",
    "en": "para ch vol fig resp viz incl",
    "de": "Nr Abs gem z d v bzw vgl Ziff S ca bspw inkl Hr Fr u sog usf",
    "fr": "M MM Mme Mlle art par ex chap al n° no",
    "es": "Sr Sra Srta art arts apdo pág págs núm núms cap D Dña",
    "bg": "чл ал т.е т стр вж напр",
    "el": "άρθ παρ π.χ δηλ βλ αρ κ",
    "hi": "अनु डॉ श्री",
    "ar": "",
}
# Words of bodies and their usual abbreviations; a capital behind a full stop goes on with their name.
BODIES = (
    "Authority|Agency|Association|Board|Bureau|Commission|Committee|Company|Council|Court|Department|Directorate|Foundation|Institute|Laboratory|Ministry|Office|Service|Society|University"
    "|Auth|Agcy|Assoc|Assn|Bd|Cncl|Comm|Cttee|Dept|Fdn|Inst|Lab|Min|Off|Univ"
)
#: What begins a sentence and no name.
DETERMINERS = "The|A|An|Any|All|Each|Every|No|This|That|These|Those|Such|Its|Their|His|Her|Der|Die|Das|Ein|Eine|Le|La|Les|Un|Une|El|Los|Las"
GERMAN_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Frequent short words that tell the Latin-script languages apart.
STOPWORDS = {
    "en": "the of and shall to is are by for",
    "de": "der die das und ist den nach wird über von",
    "fr": "le la les et de du est des pour par",
    "es": "el la los y del que con una las por",
}

_OPEN, _CLOSE = "“„«¿¡(§•—‘「『", r")\]’'\""
_CLOSING = frozenset(_CLOSE.replace("\\", ""))
_SCRIPTS = {
    "el": r"[Ͱ-Ͽἀ-῿]", "bg": r"[Ѐ-ӿ]", "ar": r"[؀-ۿ]",
    "hi": r"[ऀ-ॿ]", "th": r"[฀-๿]", "ja": r"[぀-ヿ]", "zh": r"[一-鿿]",
}
_SCRIPT_RX = {k: re.compile(v + "+") for k, v in _SCRIPTS.items()}
_NON_LATIN = re.compile(r"[Ͱ-ӿ؀-ۿऀ-ॿ฀-๿ἀ-῿぀-ヿ一-鿿]")
_STOP_OF: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _STOP_OF.setdefault(_w, []).append(_lang)
_WORD = re.compile(r"\w+")
_LETTER = re.compile(r"[^\W\d_]")

_QUOTES = re.compile(
    # an opening mark that is never closed ends at the next opening one, so it protects nothing
    "„[^„“”]+[“”]|“[^“”„]+”|«[^«»]+»|「[^「」]+」|『[^『』]+』"
)
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_SPACE = re.compile(r"\s*")
_MARKER = re.compile(r"(?:\(?\d{1,3}[.)]|\d{1,3}(?:\.\d{1,3})+\.|[A-Z]\.|§\s?\d+[.)]?|\(?[a-z]{1,5}\)|[•—–-])\s*")


def _abbreviations(lang: str) -> str:
    words = (ABBREVIATIONS[""] + " " + ABBREVIATIONS.get(lang, "")).split()
    return r"(?:^|[\s(“„«’'’/ ])(?:" + "|".join(sorted(map(regex.escape, words), key=len, reverse=True)) + r")\.$"


def _cased_rules(lang: str) -> list[tuple[bool, str, str]]:
    """Ordered rules of the scripts with upper and lower case."""
    own = {
        "de": [
            (False, r"\d{1,2}\.$", rf"\s+(?:{GERMAN_MONTHS})\b"),
            (False, r"(?:^|\s)(?:z\. ?B|d\. ?h|v\. ?H|u\. ?a|i\. ?d|z\. ?T)\.$", ""),
            (False, r"(?:^|\s)(?:z|d|v|u|i)\.$", r"\s?\p{L}\."),
        ],
        "en": [(False, r"\bi\.$", r"\s?e\."), (False, r"\bi\. ?e\.$", "")],
        "fr": [(False, r"\bp\.$", r"\s?ex\."), (False, r"\bp\. ?ex\.$", "")],
    }.get(lang, [])
    return [
        *own,
        # acts cited by number; bodies whose first words or remit are cut short
        (False, r"\b(?:Reg|Dir|Dec)\.$", r"\s*\(?(?:EU\b|EC\b|\d)"),
        (False, rf"\b(?:{BODIES})\.?\s+f\.$", r"\s+\p{Lu}"),
        (False, rf"\b(?:{BODIES})\.?\s+(?:for|f\.)\s+\p{{Lu}}\p{{Ll}}{{1,5}}\.$", r"\s+\p{Lu}"),
        (False, r"(?:^|[\s.,;:(“„«’])(?:North|South|East|West|(?!Off|Inst|Lab|Comm|Dept|Auth)\p{Lu}\p{Ll}{1,3})\.$", rf"\s+(?!(?:{DETERMINERS})\b)(?:\p{{Lu}}\p{{Ll}}+\s+){{1,2}}(?:{BODIES})\b"),
        (False, _abbreviations(lang), r"(?!\s*\n\s*\n)"),
        # a roman numeral ends a reference, an initial does not end a name unless the name is inverted
        (True, r"\b(?:Annex|Annexe|Anexo|Anhang|Chapter|Chapitre|Kapitel|Capítulo|Part|Title|Schedule)\s+[IVXLC]+\.$", r"\s*[\p{Lu}“„«¿¡(§\d]"),
        (True, r"\p{L}{2,}, \p{Lu}\.$", r"\s+\p{Lu}"),
        (False, r"(?:^|[\s(“„«])\p{Lu}\.$", r"\s*\p{L}"),
        (True, "", r"\s+e-\p{Ll}"),
        (False, "", r"\s*\p{Ll}"),
        # ordinary end of a sentence
        (True, "", rf"\s+[\p{{Lu}}\p{{Lo}}\d{_OPEN}]"),
        # the space was lost: a capital, quotation, numbered or marked paragraph follows directly
        (True, r"[\p{L}\d)\]»”“%]\s?[.!?…;][^\w\s]*$", r"[\p{Lu}][\p{Ll}’' ]|[“„«¿¡][\p{Lu}]|\(\d{1,3}\)\s|\d{1,3}\.\s+[\p{Lu}“„«¿¡]|§\s?\d|\p{Lu}\.\s\p{Lu}"),
        (False, "", ""),
    ]


_CJK_RULES = [
    # a quotation that the sentence goes on after
    (False, r"[」』”’]$", r"\s*[とのをにがはでもへ、，；并且而和的地得等]"),
    (True, "", r"\s*\S"),
]
_CASELESS_RULES = [
    (False, _abbreviations(""), ""),
    (False, r"[A-Za-z]\.$", r"\s*\S"),
    (False, "", r"\s*[a-z]"),
    (True, "", r"\s+\S"),
    (True, r"[^\W\d_][.؟!?।]$", r"[^\W\d_a-z]"),
    (False, "", ""),
]
_HINDI_RULES = [(True, "", r"\s*\S")]
_END = {
    "cased": re.compile(r"[.!?…]+"), "el": re.compile(r"[.!?…;;]+"), "cjk": re.compile(r"[。！？!?]+"),
    "hi": re.compile(r"[।॥?!]+"), "ar": re.compile(r"[.؟!?]+"), "th": re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])"),
}
_compiled: dict[str, list[tuple[bool, object, object]]] = {}


def rules_of(lang: str) -> list[tuple[bool, object, object]]:
    """The compiled cascade of a language."""
    if lang not in _compiled:
        table = {"ja": _CJK_RULES, "zh": _CJK_RULES, "hi": _HINDI_RULES, "ar": _CASELESS_RULES, "th": []}.get(lang)
        table = _cased_rules(lang) if table is None else table
        _compiled[lang] = [(b, regex.compile(x) if x else None, regex.compile(y) if y else None) for b, x, y in table]
    return _compiled[lang]


def detect_language(text: str) -> str:
    """Language of a text from its scripts, then from short words; English where nothing tells."""
    if _NON_LATIN.search(text):
        n = {k: sum(map(len, rx.findall(text))) for k, rx in _SCRIPT_RX.items()}
        latin = len(_LETTER.findall(text)) - sum(n.values())
        if sum(n.values()) * 3 >= latin:
            best = max(n, key=lambda k: n[k])
            return "ja" if best == "zh" and n["ja"] * 20 >= n["zh"] else best
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in filter(_STOP_OF.__contains__, _WORD.findall(text.lower())):
        for k in _STOP_OF[w]:
            votes[k] += 1
    best = max(votes, key=lambda k: votes[k])
    return best if votes[best] else "en"


def _decides(rules: list, text: str, start: int, j: int) -> bool:
    """What the first rule that matches around ``j`` says of a sentence that began at ``start``.

    The rules see the text behind ``j`` as far as they match, and before it the last ``WORDS_BACK`` words or the
    whole sentence, never a part of a word.
    """
    before = text[start:j]
    if j - WINDOW > start:
        at = text.rfind(" ", start, j - WINDOW) + 1
        if at > start and text.count(" ", at, j) >= WORDS_BACK:
            before = text[at:j]
    for breaks, x, y in rules:
        if (x is None or x.search(before)) and (y is None or y.match(text, j)):
            return breaks
    return False


def sentence_starts(text: str | None, lang: str | None = None) -> list[int]:
    """0-based starts of the sentences of ``text``."""
    if not text:
        return []
    first = _SPACE.match(text).end()
    if first == len(text):
        return []
    lang = lang or detect_language(text)
    rules = rules_of(lang)
    hard = {m.end() for m in _BLANK.finditer(text) if first < m.end() < len(text)}
    quotes = [(m.start(), m.end()) for m in _QUOTES.finditer(text) if not _BLANK.search(m.group())]
    end = _END.get({"ja": "cjk", "zh": "cjk"}.get(lang, lang), _END["cased"])
    starts, q, nq = [first], 0, len(quotes)
    hards = sorted(hard)
    h = 0

    def take_hard(upto: int) -> None:
        nonlocal h
        while h < len(hards) and hards[h] <= upto:
            if hards[h] > starts[-1]:
                starts.append(hards[h])
            h += 1

    for m in end.finditer(text, first):
        i, j = m.span()
        while q < nq and quotes[q][1] <= i:
            q += 1
        if lang == "th":
            take_hard(i)
            if j > starts[-1]:
                starts.append(j)
            continue
        if q < nq and quotes[q][0] < i < quotes[q][1]:
            if text[j : quotes[q][1] - 1].strip():
                continue  # inside a quotation
            j = quotes[q][1]
        while j < len(text) and text[j] in _CLOSING:
            j += 1
        k = _SPACE.match(text, j).end()
        take_hard(j)
        if k >= len(text) or k <= starts[-1] or k in hard:
            continue
        if _MARKER.fullmatch(text, starts[-1], j):
            continue
        if _decides(rules, text, starts[-1], j):
            starts.append(k)
    take_hard(len(text))
    return starts


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, langs, number, start, end, units = [], [], [], [], [], []
        for row, text in enumerate(b.column(1).to_pylist()):
            if not text:
                continue
            lang = detect_language(text)
            starts = sentence_starts(text, lang)
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)):
                unit = text[s:e].rstrip()
                at.append(row)
                langs.append(lang)
                number.append(k)
                start.append(s + 1)
                end.append(s + len(unit))
                units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), pa.array(langs, pa.string()), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(units, pa.string())],
            names=["id", "lang", "sentence_no", "start_pos", "end_pos", "sentence"],
        )


def sentence_units(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, lang, sentence_no, start_pos, end_pos, sentence); positions count characters from 1, ends inclusive.

    Row-local: no shuffle unless the input has fewer splits than there are cores.  A text crosses to Python and
    its sentences come back once; the work is linear in its length.  Repeated ids give the sentences of every row.
    """
    schema = T.StructType([
        T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("lang", T.StringType()), T.StructField("sentence_no", T.IntegerType()),
        T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("sentence", T.StringType()),
    ])
    texts = spread(rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("length(_t) > 0"))
    own = schema[0].name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unit_rows(batches):
            yield b.rename_columns([own, *b.schema.names[1:]])

    return texts.mapInArrow(run, schema)
