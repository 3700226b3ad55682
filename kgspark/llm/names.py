"""Variant spellings of names: n-gram vectors, sparse cosine join, average-linkage groups.

1. A spelling is read as words: soft hyphens, accents, look-alike digits, titles and articles are undone, nothing is
   corrected or reordered.  Spellings of the same words in the same order are one node from here on.
2. A spelling is a name if it has a word of bodies, a given name or an initial in its place, or if its words occur
   mostly in texts typed as organisation or person; a number of an act makes it an act.
3. A node's vector holds the character n-grams of its words, weighted by inverse frequency and length.  Known
   abbreviations and nicknames put the word they stand for into the vector; no list decides what is a name or a link.
4. Sparse cosine join with prefix filtering: grams are ordered by weight; two vectors of cosine >= t must share a gram
   of both prefixes, where a prefix ends once the rest of the vector is shorter than t.  The join is exact for the
   threshold; no candidate or partner is capped.
5. An exact check of the joined pairs aligns their words and removes those that name different things however similar
   they look (another kind, year or number of an act, another remit of a body, another given name in a family).
6. Components are grouped by average-linkage clustering on the cosine of the pairs that are left.

Defined results: NULL and blank names, and texts that are no person, body or act, have no variants; a name of any
length is read whole; equal spellings are one spelling; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators.components import connected_components
from kgspark.operators.skew import hot_split_join
from kgspark.session import materialize

#: Long grams of long words keep posting lists short: a typing error spoils one word, the others still match in full.
#: Words of up to ``SHORT_WORD`` letters, and all words of names with few letters of their own, have short grams.
NGRAM, SHORT_NGRAM, SHORT_WORD, FEW_LETTERS = 8, 4, 6, 12
COSINE = 0.3
#: Mass of a word that many names share (given name, type, remit) against a name's own word.
COMMON_MASS = 0.25
#: Nodes added to the count when weights are taken: in a small table the parts that variants share are not rare,
#: and without this their weight would vanish.
PRIOR_FORMS = 1000
LINKAGE = 0.2
#: A word in this share of all names (and so many at least) is a common one; there are at most 1 / share times the mean
#: number of words of a name of them.
COMMON_SHARE, COMMON_LEAST = 0.01, 60
#: Types of names in a column ``type`` (upper case) beside the acts, which their numbers tell.
NAME_TYPES = ("ORGANIZATION", "ORGANISATION", "PERSON")

# Words that make a name a body, with their abbreviations.
BODY_WORDS = {
    "authority": "auth", "agency": "agcy agy", "association": "assoc assn ass", "commission": "comm", "committee": "cttee", "department": "dept dep",
    "foundation": "fdn found", "institute": "inst", "laboratory": "lab labs", "office": "off", "board": "bd", "council": "cncl", "ministry": "min",
    "bureau": "", "university": "univ", "company": "co", "corporation": "corp", "society": "soc", "court": "ct", "directorate": "dir", "service": "svc",
}
# General words of body names with usual abbreviations.
NAME_WORDS = {
    "northern": "north", "southern": "south", "eastern": "east", "western": "west", "joint": "jt", "national": "natl nat", "international": "intl int", "european": "eur",
    "registry": "reg", "records": "rec recs", "statistics": "stats stat", "standards": "stds std", "safety": "saf", "maritime": "mar", "archives": "arch", "harbour": "harb harbor",
}
# Common given names with their short forms.
GIVEN_NAMES = {
    "alexander": "alex sasha alec sandy xander", "dorothy": "dolly dot dottie", "elizabeth": "betty beth liz lizzy eliza elsie", "francisco": "paco pancho curro",
    "giuseppe": "beppe peppe", "henrietta": "hettie etta hattie", "johannes": "hannes hans johann jan", "katherine": "kate kathy katie kitty kat",
    "leonardo": "leo nardo", "magdalena": "lena magda", "margaret": "peggy maggie meg madge", "richard": "dick rick richie", "robert": "bob rob bobby robbie bert",
    "theodore": "ted teddy theo", "vladimir": "vova volodya vlad", "william": "bill will billy willy liam", "james": "jim jimmy", "john": "jack johnny",
    "charles": "charlie chuck", "edward": "ed eddie ned", "thomas": "tom tommy", "anthony": "tony", "joseph": "joe joey", "michael": "mike mick mickey",
    "mary": "molly polly", "susan": "sue susie", "patricia": "pat patty", "frederick": "fred freddie", "andrew": "andy drew", "daniel": "dan danny",
    "samuel": "sam sammy", "benjamin": "ben benny", "matthew": "matt", "nicholas": "nick", "christopher": "chris kit", "peter": "pete", "anna": "annie nan",
}
# Acts and their abbreviations.
ACT_WORDS = {"regulation": "reg", "directive": "dir", "decision": "dec"}
TITLES = set("dr mr mrs ms miss prof professor sir dame rev hon".split())
FILL = set("of for the and de la le du des di da et und fur pour para".split())
#: What leads to the remit of a body.
REMIT_LEADS = set("for f fur pour para".split())
#: First words of concepts, obligations, rights, penalties: never names.
CONCEPTS = set("duty obligation requirement right level concept principle fine freedom penalty power notion degree prohibition".split())


def _lexicon(table: dict[str, str]) -> dict[str, str]:
    return {a: w for w, abbr in table.items() for a in [w, *abbr.split()]}


def _deletions(word: str) -> set[str]:
    """The word and what is left of it without one letter; words one error apart share one of them."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class _Lexicon:
    """Words with their abbreviations; full words of ``least`` letters are known with one typing error, too."""

    def __init__(self, table: dict[str, str], least: int) -> None:
        self.words, self.least, self.near = _lexicon(table), least, {}
        for w in table:
            for d in _deletions(w) if len(w) >= least else ():
                self.near.setdefault(d, set()).add(w)

    def find(self, token: str) -> str | None:
        if token in self.words:
            return self.words[token]
        if len(token) < self.least:
            return None
        return min((w for d in _deletions(token) for w in self.near.get(d, ()) if distance(token, w, 1) <= 1), default=None)


def distance(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein (adjacent swaps) distance, ``most + 1`` where it is larger; time is linear in the length."""
    m, n, far = len(a), len(b), most + 1
    if abs(m - n) > most:
        return far
    s = 0
    while s < m and s < n and a[s] == b[s]:
        s += 1
    while m > s and n > s and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[s:m], b[s:n]
    m, n = len(a), len(b)
    if not m or not n:
        return min(far, m + n)
    two: dict[int, int] = {}
    one = {j: j for j in range(min(n, most) + 1)}
    for i in range(1, m + 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(n, i + most) + 1):
            v = min(one.get(j, far) + 1, row.get(j - 1, far) + 1, one.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, two.get(j - 2, far) + 1)
            row[j] = v
        if min(row.values()) > most:
            return far
        two, one = one, row
    return min(far, one.get(n, far))


_BODY, _GIVEN, _ACT, _WORD = _Lexicon(BODY_WORDS, 5), _Lexicon(GIVEN_NAMES, 5), _Lexicon(ACT_WORDS, 6), _Lexicon(NAME_WORDS, 99)
_ACT_RX = re.compile(r"(?:eu |ec )?([a-z]{3,12})\.? ?(?:\(?(?:eu|ec|eec)\)?)? ?(no\.? ?)?(\d{1,4}) ?/ ?(\d{1,4})(?:/(?:eu|ec|eec))?")
_LOOKALIKE = str.maketrans("0135", "oles")
_SPLIT = re.compile(r"[\s\-,.;:()/\"“”„«»]+")


def _plain(key: str) -> str:
    s = unicodedata.normalize("NFKD", key.replace("­ ", "").replace("­", ""))
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("’", "'").replace("`", "'")
    return " ".join(s.split())


def parse_name(key: str) -> tuple[str, tuple[str, ...], tuple[str, ...], str] | None:
    """(kind, words, words of the remit, acronym beside it) of a spelling in key form; None if it cannot be a name.

    act: ('act', (kind, 'year/number'), ...).  name: its words in order without titles, articles and prepositions.
    acronym: ('acronym', (letters,), (), letters).
    """
    s = re.sub(r" ?\(\d{1,3}\)$", "", _plain(key))
    m = _ACT_RX.fullmatch(s)
    if m:
        kind = _ACT.find(m[1])
        if not kind:
            return None
        a, b = m[3], m[4]
        year, number = (b, a) if m[2] or (len(b) == 4 and len(a) < 4) else (a, b)
        return "act", (kind, f"{year}/{int(number)}"), (), ""
    s = " ".join(t.translate(_LOOKALIKE) if re.search(r"[^\W\d_]", t) and re.search(r"[0135]", t) else t for t in s.split(" "))
    acronym = ""
    m = re.search(r" ?\(([a-z]{2,8})\)$", s)
    if m:
        acronym, s = m[1], s[: m.start()]
    letters = s.replace(".", "")
    if " " not in s and letters.isalpha() and 2 <= len(letters) <= (8 if "." in s else 5) and letters not in _GIVEN.words:
        return "acronym", (letters,), (), letters
    if re.search(r"\d", s):
        return None
    raw = [t for t in (re.sub(r"'s?$|^'", "", t.strip("'")) for t in _SPLIT.split(s)) if t]
    while raw and (raw[0] in TITLES or raw[0] == "the"):
        raw = raw[1:]
    while len(raw) > 2 and raw[-1] in TITLES:
        raw = raw[:-1]
    if len(raw) < 2 or raw[0] in CONCEPTS or not all(t.replace("'", "").isalpha() for t in raw):
        return None
    words, remit, inside = [], set(), False
    for at, t in enumerate(raw):
        within = 0 < at < len(raw) - 1
        inside = (inside or (within and t in REMIT_LEADS)) and t != "of"
        if t in FILL or (within and t in REMIT_LEADS):
            continue
        words.append(t)
        if inside:
            remit.add(t)
    return ("name", tuple(words), tuple(sorted(remit)), acronym) if len(words) > 1 else None


@lru_cache(maxsize=200_000)
def meaning(token: str) -> str:
    """The word that a known abbreviation or nickname stands for, else the token."""
    return _BODY.words.get(token) or _WORD.words.get(token) or _GIVEN.words.get(token) or token


def known(word: str) -> bool:
    """Whether a word is in one of the lists."""
    return word in _BODY.words or word in _WORD.words or word in _GIVEN.words


def looks_like_name(words: tuple[str, ...]) -> bool:
    """A word of bodies, or a given name or initial at either end of a short text."""
    if any(_BODY.find(t) for t in words):
        return True
    return len(words) <= 4 and any(
        (len(words[i]) == 1 or _GIVEN.find(words[i])) and all(len(x) > 2 for x in (words[1:] if i == 0 else words[:-1])) for i in (0, -1)
    )


def _abbreviates(a: str, b: str) -> bool:
    """Whether ``a`` may stand for ``b``: its beginning, or its first letter and others in order; a plural s aside."""
    if not 1 < len(a) <= 6 or len(a) >= len(b) or a[0] != b[0]:
        return False
    s = a[:-1] if a[-1] == "s" and len(a) > 3 else a
    if b.startswith(s):
        return len(s) > 2 or len(b) <= 8
    rest = iter(b)
    return len(a) <= 5 and all(c in rest for c in s)


def _glued(a: list[str], b: list[str], most: int) -> int | None:
    """Errors between words whose spaces were lost or put in, in any order."""
    if len(a) == len(b) or len(a) > 3 or len(b) > 3 or abs(sum(map(len, a)) - sum(map(len, b))) > most:
        return None
    best = min(distance("".join(p), "".join(q), most) for p in itertools.permutations(a) for q in itertools.permutations(b))
    return best if best <= most else None


def _differ(x: str, y: str, common: frozenset[str]) -> int | None:
    """Typing errors between two words; two known or two common words are different words."""
    n = min(len(x), len(y))
    most = 2 if n >= 7 else 1 if n >= 4 else 0
    if not most or (known(x) and known(y)) or (x in common and y in common):
        return None
    d = distance(x, y, most)
    return d if d <= most else None


def align(a: tuple, b: tuple, common: frozenset[str] = frozenset()) -> tuple[bool, int]:
    """(same, short) of two parsed names: whether they may name one thing, and which tells less (1 the first, 2 the second, 3 both).

    Equal words fall away; then spaces lost or put in, typing errors (two in all), initials and abbreviations are
    tried.  Words left on both sides make them different; words left on one side must be known to be left out (a remit,
    a given name, an initial, a common word).
    """
    if a[0] != b[0]:
        return False, 0
    if a[0] == "act":
        return a[1] == b[1], 0
    wa, wb = [meaning(t) for t in a[1]], [meaning(t) for t in b[1]]
    both = Counter(wa) & Counter(wb)
    left = []
    for words in (wa, wb):
        gone, rest = both.copy(), []
        for t in words:
            if gone[t]:
                gone[t] -= 1
            else:
                rest.append(t)
        left.append(rest)
    ra, rb = left
    errors = short = 0

    def paste(most: int) -> None:
        nonlocal errors
        e = _glued(ra, rb, most) if ra and rb else None
        if e is not None:
            errors += e
            ra.clear()
            rb.clear()

    paste(1)
    for x in list(ra):
        d, y = min(((e, y) for y in rb if (e := _differ(x, y, common)) is not None), default=(0, None))
        if y is not None:
            errors += d
            ra.remove(x)
            rb.remove(y)
    for x in list(ra):
        y = next((y for y in rb if x[0] == y[0] and (len(x) == 1 or len(y) == 1)), None)
        if y is not None:
            short |= 1 if len(x) == 1 else 2
            ra.remove(x)
            rb.remove(y)
    paste(2)
    for x in list(ra):
        y = next((y for y in rb if _abbreviates(x, y) or _abbreviates(y, x)), None)
        if y is not None:
            ra.remove(x)
            rb.remove(y)
    if (ra and rb) or errors > 2:
        return False, 0
    if ra or rb:
        remit = {meaning(t) for t in (a if ra else b)[2]}
        if not all(x in remit or x in common or len(x) == 1 or x in _WORD.words or x in _GIVEN.words for x in ra or rb):
            return False, 0
        kept = wb if ra else wa
        if sum(len(t) > 2 for t in kept) < 2 and all(known(t) for t in kept):
            return False, 0
        short |= 2 if ra else 1
    return True, short


def grams_of(kind: str, words: list[str]) -> dict[str, float]:
    """Grams of a node with their share of mass: long words and a name's own words weigh more than common ones."""
    if kind == "act":
        return {f"#{words[1]}": 1.0, f"~{words[0]}": COMMON_MASS}
    own: dict[str, float] = {}

    def add(word: str, n: int, mass: float, tag: str = "") -> None:
        p = f"^{word}$"
        many = max(1, len(p) - n + 1)
        for i in range(many):
            g = tag + p[i : i + n]
            own[g] = own.get(g, 0.0) + mass / many

    full = [meaning(t) for t in words]
    for w in full:
        mass = 0.1 if len(w) == 1 else (COMMON_MASS if known(w) else 1.0) * math.sqrt(len(w) / NGRAM)
        add(w, NGRAM if len(w) > SHORT_WORD else SHORT_NGRAM, mass)
    if sum(len(w) for w in full if not known(w)) <= FEW_LETTERS:
        for w in full:
            if len(w) >= SHORT_NGRAM:
                add(w, SHORT_NGRAM, 0.5, "s")
    return own


def cosine_of(a: tuple, b: tuple) -> float:
    """Cosine of the three-letter grams of two parsed names, on which they are grouped: a typing error costs a little."""
    u, v = (Counter(w[i : i + 3] for t in p[1] for w in (f"^{meaning(t)}$",) for i in range(max(1, len(w) - 2))) for p in (a, b))
    dot = sum(n * v[g] for g, n in u.items() if g in v)
    return dot / math.sqrt(sum(n * n for n in u.values()) * sum(n * n for n in v.values()))


_PARSED = "key string, mentions bigint, yes bigint, typed bigint, kind string, words array<string>, remit array<string>, acronym string, hinted boolean"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, n, yes, typed in zip(pdf["key"], pdf["mentions"], pdf["yes"], pdf["typed"], strict=True):
            if p := parse_name(key):
                rows.append((key, n, yes, typed, p[0], list(p[1]), list(p[2]), p[3], p[0] != "name" or looks_like_name(p[1])))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r.id, g, m) for r in pdf.itertuples() for g, m in grams_of(r.kind, list(r.words)).items()]
        yield pd.DataFrame(rows, columns=["id", "gram", "share"])


def ngram_pairs(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, cosine) of all pairs of nodes (id, kind, words) with cosine >= the threshold."""
    grams = materialize(nodes.select("id", "kind", "words").mapInPandas(_grams, "id bigint, gram string, share double"), "name-grams")
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = df.select("gram", F.log((n + PRIOR_FORMS) / F.col("df")).alias("idf"))
    weighted = grams.join(idf, "gram").withColumn("m", F.col("idf") * F.col("idf") * F.col("share"))
    # mass of a vector from a gram on; the order (rarest gram first, ties by gram) is the same for all vectors
    order = W.partitionBy("id").orderBy(F.desc("idf"), "gram")
    weighted = weighted.withColumn("norm2", F.sum("m").over(W.partitionBy("id")))
    before = F.coalesce(F.sum("m").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weighted = weighted.withColumn("left2", (F.col("norm2") - before) / F.col("norm2")).withColumn("w", F.sqrt(F.col("m") / F.col("norm2")))
    # the norm of what follows the prefix: the most that a vector can gain outside the grams that both prefixes share
    inside = F.col("left2") >= F.lit(cosine * cosine) - 1e-9
    weighted = weighted.withColumn("rest", F.sqrt(F.coalesce(F.max(F.when(~inside, F.col("left2"))).over(W.partitionBy("id")), F.lit(0.0))))
    weighted = materialize(weighted.select("id", "gram", "w", "left2", "rest"), "name-vectors")
    prefix = weighted.where(inside).select("id", "gram", "w", "rest")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")))
    met = met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("dot"), F.max(F.greatest("a.rest", "b.rest")).alias("rest"))
    near = met.where(F.col("dot") + F.col("rest") >= cosine - 1e-9).select("a", "b")
    vectors = weighted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))
    both = near.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    shared = F.map_values(F.map_zip_with("va", "vb", lambda k, x, y: F.coalesce(x * y, F.lit(0.0))))  # by hashing, not by a scan for every gram
    dot = F.aggregate(shared, F.lit(0.0), lambda acc, x: acc + x)
    return both.select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= cosine)


def _check(common: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = ((r.kind, tuple(w), tuple(m)) for w, m in ((r.words_a, r.remit_a), (r.words_b, r.remit_b)))
                same, short = align(a, b, common)
                if same:
                    rows.append((r.a, r.b, 1.0 if r.kind == "act" else cosine_of(a, b), short, r.mentions_a, r.mentions_b))
            yield pd.DataFrame(rows, columns=["a", "b", "sim", "short", "mentions_a", "mentions_b"])

    return run


def average_linkage(sim: np.ndarray, threshold: float) -> list[int]:
    """Cluster labels of a similarity matrix: merge the most similar clusters while their mean is >= threshold."""
    n = len(sim)
    s = sim.astype(np.float64).copy()
    np.fill_diagonal(s, -1.0)
    size = np.ones(n)
    label = list(range(n))
    alive = np.ones(n, dtype=bool)
    while n > 1:
        i, j = divmod(int(np.argmax(s)), n)
        if s[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = merged, merged
        s[i, i] = -1.0
        s[j], s[:, j] = -1.0, -1.0
        size[i] += size[j]
        alive[j] = False
        s[i, ~alive] = -1.0
        s[~alive, i] = -1.0
        label = [i if x == j else x for x in label]
    return label


def sparse_linkage(n: int, sim: dict[tuple[int, int], float], threshold: float) -> list[int]:
    """``average_linkage`` over the similar pairs (i < j) alone; a pair that is missing counts as 0.

    Ties go to the smaller (i, j), as the first maximum of the matrix does.
    """
    total: list[dict[int, float]] = [{} for _ in range(n)]  # summed similarity to the other clusters
    heap = []
    for (i, j), v in sim.items():
        total[i][j] = total[j][i] = v
        heap.append((-v, i, j))
    heapq.heapify(heap)
    size, owner = [1] * n, list(range(n))
    members = [[i] for i in range(n)]
    while heap:
        v, i, j = heapq.heappop(heap)
        if -v < threshold:
            break
        if not size[i] or not size[j] or -v != total[i].get(j, 0.0) / (size[i] * size[j]):
            continue
        for k, x in total[j].items():
            del total[k][j]
            if k != i:
                total[i][k] = total[k][i] = total[i].get(k, 0.0) + x
        size[i], size[j], total[j] = size[i] + size[j], 0, {}
        members[i] += members[j]
        for x in members[j]:
            owner[x] = i
        for k, x in total[i].items():
            heapq.heappush(heap, (-x / (size[i] * size[k]), min(i, k), max(i, k)))
    return owner


def _group(nodes: dict[int, int], edges: list[tuple[int, int, float, int]]) -> dict[int, int]:
    """Cluster of every node (id: mentions) of a component with its checked pairs (a, b, similarity, short)."""
    ids = sorted(nodes)
    pos = {x: i for i, x in enumerate(ids)}
    sim = {(pos[a], pos[b]) if a < b else (pos[b], pos[a]): s for a, b, s, _ in edges}
    fuller: dict[int, set[int]] = {}  # the names that tell more, of each that tells less
    for a, b, _, short in edges:
        if short in (1, 2):
            less, more = (a, b) if short == 1 else (b, a)
            fuller.setdefault(pos[less], set()).add(pos[more])
    plain = {(pos[a], pos[b]) if a < b else (pos[b], pos[a]) for a, b, _, short in edges if not short}
    # a short form that fits several full ones goes with the one most mentioned, or with none
    for i, full in sorted(fuller.items()):
        near: dict[int, set[int]] = {x: set() for x in full}
        for x, y in plain:
            if x in near and y in near:
                near[x].add(y)
                near[y].add(x)
        fits, open_ = [], set(full)
        while open_:
            stack, one = [min(open_)], set()
            while stack:
                x = stack.pop()
                if x in open_:
                    open_.discard(x)
                    one.add(x)
                    stack += near[x]
            fits.append((sum(nodes[ids[x]] for x in one), -min(one), one))
        if len(fits) > 1:
            fits.sort(reverse=True)
            keep = fits[0][2] if fits[0][0] >= 2 * fits[1][0] else set()
            for x in full - keep:
                sim.pop((min(i, x), max(i, x)), None)
    label = sparse_linkage(len(ids), sim, LINKAGE)
    return {x: ids[label[i]] for i, x in enumerate(ids)}


def _clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clusters of the components that come by in order, one component in memory at a time."""

    def done(rows: list[tuple]) -> pd.DataFrame:
        nodes = {r[0]: r[4] for r in rows} | {r[1]: r[5] for r in rows}
        got = _group(nodes, [r[:4] for r in rows])
        return pd.DataFrame({"id": list(got), "cluster": list(got.values())}, dtype="int64")

    at, rows = None, []
    for pdf in batches:
        out = []
        for r in pdf[["a", "b", "sim", "short", "mentions_a", "mentions_b", "component"]].itertuples(index=False, name=None):
            if r[6] != at and rows:
                out.append(done(rows))
                rows = []
            at = r[6]
            rows.append(r)
        if out:
            yield pd.concat(out, ignore_index=True)
    if rows:
        yield done(rows)


def _names_among(parsed: DataFrame, types_given: bool) -> DataFrame:
    """The parsed spellings that are names: by their look, else by the types of the texts in which their words occur."""
    if not types_given:
        return parsed
    plain = parsed.where("not hinted")
    word = parsed.where("kind = 'name'").select("yes", "typed", F.explode(F.array_distinct("words")).alias("word"))
    word = word.groupBy("word").agg(((F.sum("yes") + 0.5) / (F.sum("typed") + 1)).alias("p"))
    each = hot_split_join(plain.select("key", F.explode("words").alias("word")), materialize(word, "name-words"), "word")
    score = each.groupBy("key").agg(F.avg("p").alias("score"))
    enough = F.when(F.col("typed") > 0, (F.col("score") >= 0.5) & (2 * F.col("yes") > F.col("typed"))).otherwise(F.col("score") >= 0.75)
    return parsed.where("hinted").unionByName(plain.join(score, "key").where(enough).select(parsed.columns))


def common_words(nodes: DataFrame) -> frozenset[str]:
    """Words of at least ``COMMON_SHARE`` of all names: at most 1 / share times the mean number of words of a name."""
    words = nodes.where("kind = 'name'").select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n = nodes.where("kind = 'name'").count()
    return frozenset(meaning(r["w"]) for r in words.where(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * n)).collect())


def link_names(names: DataFrame, name_types: tuple[str, ...] = NAME_TYPES) -> DataFrame:
    """(key, kind, mentions, cluster) for every distinct spelling (column ``key``, in key form, NULLs ignored) of a person, body or act.

    A column ``type`` tells what the mentions were taken for; without it every text that can be a name is one.  A column
    ``n`` tells how many mentions a row stands for.
    """
    spark = names.sparkSession
    types_given = "type" in names.columns
    kind = F.upper(F.trim("type")) if types_given else F.lit(None).cast("string")
    rows = names.select("key", kind.alias("t"), (F.col("n") if "n" in names.columns else F.lit(1)).cast("bigint").alias("n")).where("key <> ''")
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    keys = rows.groupBy("key").agg(F.sum("n").alias("mentions"), sum_if(F.col("t").isin(*name_types)).alias("yes"), sum_if(F.col("t") != "").alias("typed"))
    parsed = materialize(keys.mapInPandas(_parse, _PARSED), "name-keys")
    parsed = _names_among(parsed, types_given)
    # an acronym stands for the body that is most often written beside it
    spelled = parsed.where("kind = 'name' and acronym <> ''").groupBy("acronym", "words").agg(F.sum("mentions").alias("n"), F.first("remit").alias("remit"))
    means = spelled.groupBy("acronym").agg(F.max_by(F.struct("words", "remit"), F.struct("n", "words")).alias("m"))
    short = parsed.where("kind = 'acronym'").select("key", "mentions", "acronym").join(means, "acronym").select("key", "mentions", F.lit("name").alias("kind"), "m.words", "m.remit")
    spellings = parsed.where("kind <> 'acronym'").select("key", "mentions", "kind", "words", "remit").unionByName(short)
    spellings = materialize(spellings.withColumn("id", F.xxhash64("kind", "words")), "name-spellings")
    nodes = spellings.groupBy("id").agg(F.first("kind").alias("kind"), F.first("words").alias("words"), F.max("remit").alias("remit"), F.sum("mentions").alias("mentions"))
    nodes = materialize(nodes, "name-nodes")
    common = common_words(nodes)
    cols = ["kind", "words", "remit", "mentions"]
    side = lambda s: nodes.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    both = ngram_pairs(nodes).join(side("a"), "a").join(side("b"), "b").where("kind_a = kind_b").withColumnRenamed("kind_a", "kind")
    # the rows are few but the work per row is not, so the number of tasks is set and not left to their size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    both = both.select("a", "b", "kind", *[f"{c}_{s}" for s in "ab" for c in cols[1:]]).repartition(tasks, "a", "b")
    checked = materialize(both.mapInPandas(_check(common), "a bigint, b bigint, sim double, short int, mentions_a bigint, mentions_b bigint"), "name-pairs")
    comp = connected_components(checked, "a", "b")
    edges = checked.join(comp.select(F.col("id").alias("a"), "component"), "a")
    clusters = edges.repartition(tasks, "component").sortWithinPartitions("component").mapInPandas(_clusters, "id bigint, cluster bigint")
    return spellings.join(clusters, "id", "left").select("key", "kind", "mentions", F.coalesce("cluster", "id").alias("cluster"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different spellings of a cluster, the smaller first."""
    a, b = linked.alias("a"), linked.alias("b")
    on = (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.key") < F.col("b.key"))
    return a.join(b, on).select(F.col("a.key").alias("name_a"), F.col("b.key").alias("name_b")).distinct()
