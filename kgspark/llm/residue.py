"""Template residue and error pages: labels spread over near-duplicate passages and near-duplicate documents.

1. One pass over the texts computes a 128-bit SimHash of five-word shingles, the hash of the normalised text and the
   *candidate passages*: sentences that hold a word of error pages or something like a slot, every sentence of a short
   page, and what follows a capital inside such a sentence (a message is often glued to navigation or cut-off text).
   Numbers and slots are masked, so one message is one passage whatever its number or the syntax of its slot.
2. A passage is *trusted* where nothing but residue looks like it: a slot syntax that prose does not use, a status
   code before a failure, a demand to switch scripts on, a run of filler words, one sentence three times over; or a
   message that stands alone on a page.  The same message inside real text, a slot in a syntax that prose uses too and
   every variant are *not* trusted by themselves.
3. Passages equal after masking form a class.  Partitioned SimHash tables find near classes, the Hamming distance and
   the Jaccard similarity of their five-word shingles (0.8 or more) verify them, and the trusted labels go through
   the connected components.  A document that holds a passage of a labelled component holds residue.
4. The same is done with whole documents: a near copy of a document with residue is residue too, unless none of the
   component's residue passages is left in it, a quarter of a passage's characters being wrong at most.

Every table keys on a sample of the fingerprint's bits.  The number of bits follows the number of classes so that
buckets keep their size, and the number of tables follows from the bits so that a pair of similarity 0.8 meets with
probability ``RECALL``.

Defined results: rows without an id are left out; NULL, empty and blank texts are no residue and have no
near-duplicates; texts shorter than five words are one shingle; scripts without spaces are shingled by character.
What stands between quotation marks by itself is talked about and no residue.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.components import connected_components
from kgspark.operators.skew import hot_split_join
from kgspark.session import materialize, spread

SHINGLE, SIMILARITY, BITS, RECALL = 5, 0.8, 128, 0.93
#: Classes in a bucket from which on a link to the bucket's first class stands for those among its near ones.
HOT_BUCKET = 128
#: A page of at most so many words (navigation left out) may be a message that stands alone.
PAGE_WORDS = 40

# Words of error pages, browser checks and demands for scripts, lower case.  One of them makes a sentence
# a candidate; two of them on a page that holds nothing else make it a page of error messages.
EVIDENCE = {
    "en": [
        "error", "exception", "traceback", "not found", "not be found", "no longer available", "unavailable", "not available", "not exist", "could not be", "cannot be",
        "cannot connect", "failed", "went wrong", "unexpected", "timed out", "time out", "expired", "denied", "forbidden", "gateway", "upstream", "server", "backend", "database",
        "too many", "requests", "rate limit", "retry", "try again", "try reloading", "maintenance", "check back", "temporarily", "session", "sign in", "log in to", "permission", "resource",
        "been moved", "deleted", "removed", "identifier", "browser", "supported", "newer version", "javascript", "scripts", "scripting", "cookies", "loading", "wait", "refresh",
        "reload", "go back", "home page", "this page", "the page", "page not", "verifying", "verify that", "verify you", "human", "robot", "captcha", "few seconds", "checking", " js ", "missing", "rejected", "status ", "http", "code: ", "respond in time", "rendering", "this site", "undefined", "nan ", "<noscript", "disabled",
    ],
    "de": ["fehler", "nicht gefunden", "angeforderte", "seite", "aktivieren", "anmelden", "abgelaufen", "nicht verfügbar", "versuchen sie"],
    "fr": ["erreur", "introuvable", "demandé", "déplacé", "supprimé", "activer", "réessayer", "expiré"],
    "es": ["página", "no existe", "solicitada", "navegador", "no admite", "active ", "caducad", "inténtelo", "no se encuentra"],
}
# The words of the usual Latin filler.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua justo turpis orci congue "
    "lectus sapien diam velit tempus mauris purus ligula massa quis porta nibh augue erat felis nunc vitae vel neque nulla urna"
)
_NAME = r"[A-Za-z][\w.]*(?: [\w.]+){0,4}"
# Slot syntaxes that prose does not use.
STRONG_SLOTS = [
    r"\{\{[^{}]{0,60}\}\}", r"\{%[^{}]{0,60}%\}", r"\$\{[^{}]{0,60}\}", r"<%.{0,60}?%>", r"\[\[[^\[\]]{1,60}\]\]", rf"@@{_NAME}@@",
    r"\[(?i:insert|todo|tbd|enter|add|your|fill in|type) [^\[\]]{1,50}\]", r"\[[^\[\]]{1,50}: ?to be (?:completed|added|confirmed)\]",
    r"\[(?:lieu|date à compléter|nom|à compléter|Name einsetzen|Datum einsetzen|lugar|fecha|nombre)\]", r"\[ ?(?:●|…|\.\.\.|_+) ?\]", r"\[object Object\]",
    r"DD/MM/YYYY", r"TT\.MM\.JJJJ", r"JJ/MM/AAAA", r"DD/MM/AAAA", r"_{4,}", r"__\.__\.", r"\?{3,}", r"#REF!", r"#N/A", r"#VALUE!", r"\(null\)",
    r"\bTBD TBD", r"\bArticle XX\b", r"\bNaN (?:pages|items)",
]
# Slot syntaxes that prose, mathematics or markup may use as well.
WEAK_SLOTS = [
    rf"\{{(?:\d+:)?{_NAME}\}}", r"<<[^<>]{1,60}>>", rf"__{_NAME}__", rf"#{_NAME}#", rf"%{_NAME}%", rf"\${_NAME}\$",
    rf"<(?!/?(?:noscript|title)>){_NAME}>", r"«(?:[a-z]+(?:[_.][a-z]+)*|[A-Z]{2,}|[A-Z][a-z]+[A-Z]\w*)(?: [a-z]+){0,3}»",
]
_STRONG = re.compile("|".join(STRONG_SLOTS))
_SLOTS = re.compile(rf"(?=[{{$<\[@_?#(«%DTJAN])(?:{'|'.join(STRONG_SLOTS + WEAK_SLOTS)})")  # the characters that slots begin with
#: A quotation without a sentence end inside: its content is talked about.
_QUOTED = re.compile(r"[“„\"«»‘‚](?:(?![.!?…] )[^“”„\"«»\n]){1,200}[”“\"»«’]")
_CODE = re.compile(
    r"\b[45]\d\d ?[.:|–—-]? ?(?:the|this|your) (?:[\w-]+ ){1,3}(?:is (?:missing|unavailable|not available)|has been (?:moved|deleted|removed)|(?:could|can) ?not be \w+|failed to \w+|was (?:rejected|not found)|timed out|does not exist|cannot)"
)
_STATUS = re.compile(r"\b(?:503 service unavailable|404 not found|502 bad gateway|500 internal server error|403 forbidden|504 gateway time-?out)[.!]?(?: |$)(?!when|if|for|where|is |as |means|shall|and )")
_SCRIPT = re.compile(
    r"\b(?:please|kindly|you (?:must|have to|need to)|to continue,|nothing happens,|sorry, but you have to|bitte) (?:enable|activate|turn on|switch on|allow|aktivieren sie) (?:js|java ?script|scripts?|scripting|cookies)\b"
    r"|(?:^|[.!?…] )(?:enable|activate|turn on|switch on|allow) (?:js|java ?script|scripts|scripting)\b(?! in order to)"
)
_MARKUP = re.compile(r"<noscript>[^<]{0,60}")
_FILLER = re.compile(rf"(?:\b(?:{'|'.join(FILLER.split())})\b[ .,;:]*){{5,}}")
# Instructions where content should stand.
_HERE = re.compile(
    r"\b(?:your|votre|ihr|su|insert|enter|type) (?:text|title|name|content|texte|titre|nom|titel|texto|título|nombre) (?:here|ici|hier|aquí)\b"
    r"|\b(?:text|title|content) (?:of [\w ]{1,30} )?goes here\b|\bhier steht später\b|\bdummy text,|\b(?:asdf|blah|qwer) (?:asdf|blah|qwer)\b|\btest test test\b|\bx{3,}(?: x{2,})+\b"
)
#: A sentence that lays down a rule or reports what something says speaks about errors.
_SPEECH = re.compile(r"\b(?:shall|article|paragraph|regulation|such as|means|returns?|answers|explains?|notes that|reads|states|says|when an?|where an?|those that|that answers?|may appeal|in order to)\b|\bthat (?!you|we)\w+(?: \w+)? are\b")
_PLAIN = re.compile(r"[a-z]+(?: [a-z]+){0,5}")
_WORDLESS = re.compile(r"[฀-๿぀-ヿ一-鿿]")
_CUT = re.compile(r"(?<=[.!?…。！？])\s+|\s[|]\s")
#: Where a message may begin inside a sentence: a capital behind a small letter, or a run of capitals.
_GLUED = regex.compile(r"(?<=[\p{Ll}\d,;>/◦] )(?:\p{Lu}\p{Ll}* ?[,:]? (?=[\p{Ll}\d])|\p{Lu}{2,}[,:]? (?=[\p{Lu}\d]))")
_DIGITS = re.compile(r"\d+")
_EDGES = " .,;:!?…-–—|/>*"
_M = np.array([0x9E3779B97F4A7C15 ** (i + 1) % 2**64 | 1 for i in range(SHINGLE)], dtype=np.uint64)
SLOT, QUOTE = "▢", "◦"


def normalise(text: str) -> str:
    """Lower case, soft hyphens with the space they left removed, white space collapsed."""
    return " ".join(_joined(text).lower().split())


def _joined(text: str) -> str:
    """Words cut by soft hyphens put together again."""
    return text.replace("­ ", "").replace("­\n", "").replace("­", "") if "­" in text else text


_EVIDENT, _FILLER_WORD, _OPENER, _HERE_WORD = range(4)
#: What any slot holds; the patterns of slots are tried only on texts with one of these.
OPENERS = ["{", "[", "<", "@@", "#", "$", "__", "???", "/yyyy", ".jjjj", "/aaaa", "(null", "tbd", "article xx", "nan ", *(f"{x}{c}" for x in "%«" for c in "abcdefghijklmnopqrstuvwxyz")]


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {w: (_OPENER, w) for w in OPENERS} | {w: (_EVIDENT, w) for group in EVIDENCE.values() for w in group}
    words |= {f" {w} ": (_FILLER_WORD, w) for w in FILLER.split()} | {w: (_HERE_WORD, w) for w in (" here", " ici", "hier steht", " aquí", "dummy text", "asdf", "blah", "test test", "xxx")}
    for w, v in words.items():
        a.add_word(w, v)
    a.make_automaton()
    return a


_AC = None


def evidence(norm: str) -> tuple[set[str], int, bool, bool]:
    """(distinct words of error pages, filler words, whether there may be a slot, or an instruction) of a normalised text."""
    global _AC
    _AC = _AC or _automaton()
    seen, n = set(), [0, 0, 0, 0]
    for _, (kind, w) in _AC.iter(norm):
        n[kind] += 1
        if kind == _EVIDENT:
            seen.add(w)
    return seen, n[_FILLER_WORD], n[_OPENER] > 0, n[_HERE_WORD] > 0


def _repeated(norm: str) -> tuple[str, bool]:
    """A short plain sentence written twice over, else '', and whether it is there three times over."""
    if ". " not in norm:
        return "", False
    parts = norm.rstrip(".").split(". ")
    twice = ""
    for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
        if a == b and _PLAIN.fullmatch(a):
            if parts[i + 2 : i + 3] == [a]:
                return a, True
            twice = a
    return twice, False


def _mask(s: str) -> str:
    """A passage in the form in which passages are compared."""
    return _DIGITS.sub("0", s.lower()).strip(_EDGES)


#: A passage: its masked form, whether it is trusted, the slots as written.
Passage = tuple[str, bool, list[str]]


def residue_passages(text: str, norm: str) -> list[Passage]:
    """Candidate passages of a text; trusted ones are unmistakable by themselves or stand alone on their page."""
    seen, filler, slots, here = evidence(norm)
    short = norm.count(" ") < PAGE_WORDS + 20
    again, thrice = _repeated(norm)
    if not (seen or slots or again or here or filler >= 3):
        return []
    found: dict[str, list] = {}

    def add(p: str, trusted: bool, own: list[str]) -> None:
        if p and (SLOT in p or " " in p or trusted):
            got = found.setdefault(p, [False, []])
            got[0] |= trusted
            got[1] += [s for s in own if s not in got[1]]

    if again:
        add(_mask(again), thrice, [])
    plain: list[tuple[str, set[str], bool]] = []
    for para in re.split(r"\n\s*\n", _joined(text)):
        flat = _QUOTED.sub(lambda m: m.group() if _SLOTS.fullmatch(m.group()) else f" {QUOTE} ", " ".join(para.split()))
        low = flat.lower()
        for rx in (*((_CODE, _STATUS, _SCRIPT, _MARKUP) if seen else ()), *((_FILLER,) if filler >= 2 else ()), *((_HERE,) if here else ())):
            for m in rx.finditer(low):
                add(_mask(m.group()), True, [])
        holed = slots and _SLOTS.search(flat) is not None
        if not (holed or seen or short):
            continue
        for s in _CUT.split(flat):
            own: list[str] = []
            strong = False
            if holed and _SLOTS.search(s):
                strong = _STRONG.search(s) is not None
                own = [normalise(m.group()) for m in _SLOTS.finditer(s)]
                s = _SLOTS.sub(SLOT, s)
            ev = evidence(s.lower())[0] if seen else set()
            if own or ev or short:
                plain.append((s, ev, bool(own)))
            if own:
                for v in _variants(s):
                    if SLOT in v:
                        add(_mask(v), strong, own)
    # a message that stands alone: nothing on the page but messages and short navigation
    words = sum(len(s.split()) for s, ev, slot in plain if ev and not slot)
    other = any(not ev and not slot and len(s.split()) > 6 for s, ev, slot in plain)
    distinct = set().union(*(ev for _, ev, _ in plain)) if plain else set()
    alone = short and not other and words <= PAGE_WORDS and len(distinct) >= 2 and not any(ev and _SPEECH.search(s.lower()) for s, ev, _ in plain)
    for s, ev, slot in plain:
        if ev and not slot:
            for v in _variants(s):
                if v is s or evidence(v.lower())[0]:
                    add(_mask(v), alone, [])
    return [(p, t, own) for p, (t, own) in found.items()]


def _variants(s: str) -> list[str]:
    """A sentence and what may be a message in it: from a place where one may begin, up to such a place, between two."""
    cuts = [m.start() for m in _GLUED.finditer(s) if m.start()]
    if not cuts:
        return [s]
    return [s, *(s[i:] for i in cuts), *(s[:i] for i in cuts), *(s[i:j] for i, j in zip(cuts, cuts[1:], strict=False))]


#: A passage is compared in pieces of at most so many characters, white space left out.
PASSAGE_PIECE = 64


def _squeeze(text: str) -> str:
    return "".join(text.split())


def pieces_of(p: str, slots: list[str]) -> list[str]:
    """What has to be left of a residue passage in a near copy: its slots, else its text, in pieces of ``PASSAGE_PIECE``."""
    out = set()
    for x in map(_squeeze, (_DIGITS.sub("0", s) for s in slots) if slots else [p]):
        n = -(-len(x) // PASSAGE_PIECE)
        out |= {x[i * len(x) // n : (i + 1) * len(x) // n] for i in range(n)}
    return sorted(out)


def holds_passage(text: str, wanted: list[str]) -> bool:
    """Whether a text holds one of the passages, damaged in a quarter of its characters at most; numbers are masked.

    Of k + 1 parts of a passage one survives k errors unchanged, so only the places where a part occurs are compared.
    """
    squeezed = _squeeze(_DIGITS.sub("0", normalise(_QUOTED.sub(" ", text))))
    for p in wanted:
        k = len(p) // 4
        rx = regex.compile(f"(?:{regex.escape(p)}){{e<={k}}}")
        for i in range(k + 1):
            a, b = i * len(p) // (k + 1), (i + 1) * len(p) // (k + 1)
            at = squeezed.find(p[a:b])
            while at >= 0:
                if rx.search(squeezed, max(0, at - a - k), min(at - a + len(p) + k, len(squeezed))):
                    return True
                at = squeezed.find(p[a:b], at + 1)
    return False


class _Words(dict):
    """Hashes of words, kept while the vocabulary is small."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def _word_hashes(norm: str) -> np.ndarray:
    words = norm.split(" ")
    if len(norm) > 25 * len(words) and _WORDLESS.search(norm):
        words = list(norm.replace(" ", ""))
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(norm: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    if not norm:
        return np.empty(0, np.uint64)
    w = _word_hashes(norm)
    n = max(1, len(w) - SHINGLE + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        acc += w[k : k + n] * _M[k]
    return np.unique(_mix(acc))


_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhash(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2) fingerprints of 64 bits each; empty sets give 0."""
    out = np.zeros((len(sets), 2), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    both = np.stack([flat, _mix(flat * np.uint64(0xD6E8FEB86659FD93))], axis=1)
    # eight 8-bit counters per word: runs of at most 255 shingles cannot overflow, then runs add up per text
    lanes = _LANES[both.view(np.uint8)]
    size = np.array([len(sets[i]) for i in full])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    runs = (size + 254) // 255
    run_first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    at = np.repeat(first - run_first * 255, runs) + np.arange(runs.sum()) * 255
    counts = np.add.reduceat(lanes, at, axis=0).view(np.uint8)
    ones = np.add.reduceat(counts, run_first, axis=0, dtype=np.int32)
    out[full] = np.packbits((2 * ones > size[:, None]).astype(np.uint8), axis=1).view(np.uint64)
    return out


def _miss(similarity: float) -> float:
    """Probability that one SimHash bit differs at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def table_plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits per key, tables, Hamming radius) for n classes."""
    miss = _miss(similarity)
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2))) - 4))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - miss) ** bits))
    radius = math.ceil(BITS * miss + 2.5 * math.sqrt(BITS * miss * (1 - miss)))
    return bits, tables, radius


def _masks(bits: int, tables: int, seed: int) -> list[tuple[int, int]]:
    """The sample of bits that each table keys on, as masks of the two halves of a fingerprint."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        mask = sum(1 << int(x) for x in rng.choice(BITS, size=bits, replace=False))
        out.append(tuple((h ^ (1 << 63)) - (1 << 63) for h in (mask & (2**64 - 1), mask >> 64)))
    return out


def keyed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(bucket, id, f1, f2) of every class and table; made in the JVM."""
    keys = [F.xxhash64(F.col("f1").bitwiseAND(m1), F.col("f2").bitwiseAND(m2), F.lit(t)) for t, (m1, m2) in enumerate(_masks(bits, tables, seed))]
    return classes.select(F.explode(F.array(*keys)).alias("bucket"), F.col("cid").alias("id"), "f1", "f2")


def _shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        norms = [normalise(t) for t in pdf["text"]]
        sets = [(shingles(n) >> np.uint64(32)).astype(np.uint32).view(np.int32) for n in norms]
        yield pd.DataFrame({"text_hash": [xxhash.xxh3_128_hexdigest(n) for n in norms], "s": sets})


_PASSAGES = "array<struct<p:string,trusted:boolean,slots:array<string>>>"
_SIGNED = f"doc_id bigint, text_hash string, n_shingles int, f1 bigint, f2 bigint, trusted boolean, passages {_PASSAGES}"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            norms = [normalise(t) for t in texts]
            sets = [shingles(n) for n in norms]
            f = simhash(sets).view(np.int64)
            found = [residue_passages(t, n) if n else [] for t, n in zip(texts, norms, strict=True)]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "text_hash": [xxhash.xxh3_128_hexdigest(n) if n else None for n in norms],
                "n_shingles": [len(s) for s in sets], "f1": f[:, 0], "f2": f[:, 1],
                "trusted": [any(t for _, t, _ in ps) for ps in found],
                "passages": [[{"p": p, "trusted": t, "slots": own} for p, t, own in ps] for ps in found],
            })


def _apart(a: str, b: str):
    return F.bit_count(F.col(f"{a}.f1").bitwiseXOR(F.col(f"{b}.f1"))) + F.bit_count(F.col(f"{a}.f2").bitwiseXOR(F.col(f"{b}.f2")))


def _pairs(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: classes of two keyed tables in one bucket within the Hamming radius; either side may hold the smaller id."""
    x, y = left.alias("x"), right.alias("y")
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") != F.col("y.id")) & (_apart("x", "y") <= radius))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_classes(classes: DataFrame, name: str, seed: int, sets: Callable[[DataFrame], DataFrame], star: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: classes (cid, f1, f2) that meet in a SimHash table, lie within the Hamming radius and are similar.

    ``sets`` gives the shingle sets (cid, s) of a table of ids (cid).  With ``star``, which keeps the components but not
    every link, the classes of a hot bucket are held against its first class alone, and only those that are not
    similar to it against all others: m near copies of one page cost m links instead of m squared.
    """
    bits, tables, radius = table_plan(classes.count())
    rows = keyed(classes, bits, tables, seed)
    first = None
    if star:
        first = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "f1", "f2")).alias("m")).where(F.col("n") >= HOT_BUCKET)
        first = materialize(first.select("bucket", "m.*"), f"{name}-first")  # at most tables / HOT_BUCKET rows per class
    if first is None or not first.limit(1).count():
        near = materialize(_pairs(rows, rows, radius), f"{name}-near")
        return materialize(verified(near, sets(_ids(near))), f"{name}-pairs")
    cold = rows.join(first.select("bucket"), "bucket", "left_anti")
    hot = materialize(rows.join(first.select("bucket"), "bucket", "left_semi"), f"{name}-hot")
    near = materialize(_pairs(cold, cold, radius).unionByName(_pairs(hot, first, radius)).distinct(), f"{name}-near")
    pairs = materialize(verified(near, sets(_ids(near))), f"{name}-pairs")
    # what a bucket's first class does not stand for
    to_first = hot.join(first.select("bucket", F.col("id").alias("f")), "bucket")
    linked = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    alone = to_first.where("id <> f").join(linked.select(F.col("a").alias("id"), F.col("b").alias("f")), ["id", "f"], "left_anti").select("bucket", "id", "f1", "f2")
    more = materialize(_pairs(alone, hot, radius).join(pairs, ["a", "b"], "left_anti"), f"{name}-more")
    return materialize(pairs.unionByName(verified(more, sets(_ids(more)))), f"{name}-all-pairs")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()


def verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets (cid, s) have a Jaccard similarity of ``SIMILARITY`` or more."""
    both = near.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def near_duplicates(docs: DataFrame, seed: int = 7, star: bool = False) -> dict[str, DataFrame]:
    """``signed`` (per row: hash, passages), ``classes`` (one row per distinct text: cid, smallest doc_id, copies), ``pairs`` (a, b, similarity of classes by cid)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    signed = materialize(spread(rows).mapInPandas(_sign, _SIGNED), "residue-signed")
    classes = materialize(
        signed.where("text_hash is not null").groupBy("text_hash").agg(
            F.xxhash64(F.first("text_hash")).alias("cid"), F.min("doc_id").alias("doc_id"), F.first("f1").alias("f1"), F.first("f2").alias("f2"),
            F.count(F.lit(1)).alias("copies"),
        ), "residue-classes",
    )

    def sets(ids: DataFrame) -> DataFrame:
        # the texts of the smallest ids of these classes; an id that stands for several texts brings them all
        # as a table of its own its size is known, so the texts are only shuffled if it is too large to broadcast
        wanted = materialize(classes.join(ids, "cid", "left_semi").select("doc_id").distinct(), "residue-wanted")
        out = rows.join(wanted, "doc_id", "left_semi").where("text is not null").mapInPandas(_shingle_rows, "text_hash string, s array<int>")
        return materialize(out.withColumn("cid", F.xxhash64("text_hash")).dropDuplicates(["cid"]).select("cid", "s"), "residue-sets")

    return {"signed": signed, "classes": classes, "pairs": near_classes(classes.select("cid", "f1", "f2"), "residue", seed, sets, star)}


def representative_pairs(t: dict[str, DataFrame]) -> DataFrame:
    """(doc_a, doc_b, similarity): the verified links by the smallest document of each class."""
    a, b = (t["classes"].select(F.col("cid").alias(s), F.col("doc_id").alias(f"doc_{s}")) for s in ("a", "b"))
    return t["pairs"].join(a, "a").join(b, "b").select("doc_a", "doc_b", "similarity")


_PASSAGE_CLASS = "p string, cid bigint, trusted boolean, f1 bigint, f2 bigint, s array<int>"


def _sign_passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(p) for p in pdf["p"]]
        f = simhash(sets).view(np.int64)
        yield pd.DataFrame({"p": pdf["p"], "cid": pdf["cid"], "trusted": pdf["trusted"], "f1": f[:, 0], "f2": f[:, 1], "s": [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in sets]})


def label_passages(signed: DataFrame, seed: int = 11) -> DataFrame:
    """(p, component, trusted, labelled) of every distinct candidate passage; a component with a trusted one is labelled."""
    each = signed.select(F.explode("passages").alias("x")).select("x.p", "x.trusted")
    # one passage may stand in a third of all documents: the count of its copies is combined on the map side
    classes = each.groupBy("p").agg(F.max("trusted").alias("trusted")).withColumn("cid", F.xxhash64("p"))
    classes = materialize(classes.mapInPandas(_sign_passages, _PASSAGE_CLASS), "residue-passages")
    pairs = near_classes(classes.select("cid", "f1", "f2"), "residue-passages", seed, lambda ids: classes.select("cid", "s"), star=True)
    comp = connected_components(pairs, "a", "b")
    member = classes.select("p", "cid", "trusted").join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left")
    member = member.select("p", "trusted", F.coalesce("component", "cid").alias("component"))
    known = member.where("trusted").select("component").distinct().withColumn("_k", F.lit(True))
    return member.join(known, "component", "left").select("p", "component", "trusted", F.coalesce("_k", F.lit(False)).alias("labelled"))


def _hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"text_hash": [xxhash.xxh3_128_hexdigest(normalise(t)) for t in pdf["text"]], "text": pdf["text"]})


def _damaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        holds = [holds_passage(t, sorted({x for p, own in zip(ps, slots, strict=True) for x in pieces_of(p, list(own))})) for t, ps, slots in zip(pdf["text"], pdf["ps"], pdf["slots"], strict=True)]
        yield pd.DataFrame({"text_hash": pdf["text_hash"], "holds": holds})


def label_classes(docs: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(text_hash, doc_id, component, in_component, trusted, marked, holds) of every class of equal texts.

    ``marked``: it holds a labelled passage; ``in_component``: some class of its component does; ``holds``, only where it
    decides: a passage of its component is left in it, perhaps damaged.
    """
    labelled = materialize(label_passages(t["signed"]).where("labelled").select("p"), "residue-labelled")
    # copies are combined first, so a passage is as frequent as it is in different texts; the hot-key join splits those
    x = t["signed"].where("text_hash is not null").select("text_hash", F.explode("passages").alias("x")).select("text_hash", "x.*")
    x = x.groupBy("text_hash", "p").agg(F.max("trusted").alias("trusted"), F.first("slots").alias("slots"))
    x = hot_split_join(materialize(x, "residue-text-passages"), labelled, "p")
    marks = materialize(x.groupBy("text_hash").agg(F.max("trusted").alias("trusted"), F.collect_list(F.struct("p", "slots")).alias("residue")), "residue-marks")
    comp = connected_components(t["pairs"], "a", "b")
    member = t["classes"].join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    member = member.join(marks.select("text_hash", "trusted", F.lit(True).alias("marked")), "text_hash", "left")
    member = member.select("text_hash", "doc_id", "component", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("marked", F.lit(False)).alias("marked"))
    member = materialize(member, "residue-members")
    spread_to = materialize(member.groupBy("component").agg(F.max("marked").alias("in_component"), F.min("marked").alias("all_marked")).where("in_component"), "residue-components")
    mixed = materialize(member.join(spread_to.where("not all_marked").select("component"), "component").select("text_hash", "doc_id", "component", "marked"), "residue-mixed")
    out = member.join(spread_to.select("component", "in_component"), "component", "left").withColumn("in_component", F.coalesce("in_component", F.lit(False)))
    cols = ["text_hash", "doc_id", "component", "in_component", "trusted", "marked"]
    if not mixed.limit(1).count():  # no near copy of a document with residue lacks its passages
        return out.select(*cols, F.lit(False).alias("holds"))
    known = mixed.where("marked").select("text_hash", "component").join(marks, "text_hash").select("component", F.explode("residue").alias("r")).select("component", "r.p", "r.slots").distinct()
    known = materialize(known.groupBy("component").agg(F.collect_list(F.struct("p", "slots")).alias("r")).select("component", F.col("r.p").alias("ps"), F.col("r.slots").alias("slots")), "residue-known")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    asked = rows.join(mixed.where("not marked").select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInPandas(_hash_rows, "text_hash string, text string").dropDuplicates(["text_hash"])
    asked = asked.join(mixed.where("not marked").select("text_hash", "component"), "text_hash").join(known, "component")
    holds = materialize(asked.select("text_hash", "text", "ps", "slots").mapInPandas(_damaged, "text_hash string, holds boolean"), "residue-holds")
    return out.join(holds, "text_hash", "left").select(*cols, F.coalesce("holds", F.lit(False)).alias("holds"))


def find_residue(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, component, trusted, residue) for every row with text."""
    t = near_duplicates(docs, star=True)
    label = label_classes(docs, t)
    label = label.select("text_hash", F.col("doc_id").alias("class_id"), "component", (F.col("marked") | F.col("holds")).alias("residue"))
    out = hot_split_join(t["signed"].where("text_hash is not null").select("doc_id", "text_hash", "trusted"), label, "text_hash")
    return out.select("doc_id", "class_id", "component", "trusted", "residue")


def propagation_report(docs: DataFrame) -> DataFrame:
    """One row of classes of equal texts: trusted themselves, added by a labelled passage, by a near copy, and near copies without residue."""
    t = label_classes(docs, near_duplicates(docs, star=True)).where("in_component")
    return t.agg(
        F.count_if("trusted").alias("trusted"), F.count_if(F.expr("marked and not trusted")).alias("added_by_passage"),
        F.count_if(F.expr("holds and not marked")).alias("added_by_copy"), F.count_if(F.expr("not marked and not holds")).alias("removed"),
    )
