"""Personal data by bootstrapped contextual extraction.

Four kinds have rules of their own (email, ip, card, phone); what these find
are seeds and base spans. A fifth kind, secrets, has seeds alone: long words of
mixed letters and digits that are quoted behind an assignment. Seeds induce
lexical patterns: the two words before an identifier; the word before with the
word after; and, behind punctuation, that punctuation with the identifier's
shape. Patterns and instances form a graph that Spark scores in rounds: a
pattern is as good as the share of known entities among the different
identifiers it meets, an identifier is the noisy-or of its good patterns.
Identifiers that high-confidence patterns agree on are added under the kind of
those patterns. A seed of a secret is added only if patterns confirm it.

The text is read once; the graph holds one row per identifier occurrence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.text import map_texts, slices, stored

#: Kinds with rules, and all kinds in the order of the spans.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
ROUNDS = 3
#: A pattern counts from this much known support and confidence; an identifier is added from this score.
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.8
#: Digits that an identifier without @ has at least.
MIN_DIGITS = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}\"'#*$%&|<>"
#: A seed of a secret: so many characters at least, of these, with letters and digits and this entropy in bits a character.
SECRET_CHARS = 20
SECRET_BITS = 3.0
_SECRET = re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9+/_=-]+")
_ASSIGNED = re.compile(r"[=:]\s{0,3}[\"'`]$")
_SHAPES = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[0-9a-f]*[0-9][0-9a-f]*|[0-9A-F]*[0-9][0-9A-F]*"), "hex"), (re.compile(r"[A-Za-z0-9]+"), "mix"), (re.compile(r"[A-Za-z0-9+/_=-]+"), "code")]
#: Words of more characters enter patterns as a digest.
LONG_WORD = 100


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, leftmost, not overlapping.

    Found from each @, so a long run without one costs nothing: a match's local
    part is all of the run before the @ that the last match left.
    """
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > upto and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        upto = m.end() if m else at + 1
        at = text.find("@", upto)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four kinds, by start, then kind as listed; code points, end exclusive."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _named(text: str) -> bool:
    return "@" in text or len(_DIGIT.findall(text)) >= MIN_DIGITS


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a] in _EDGE or text[a].isspace()):
        a += 1
    while b > a and (text[b - 1] in _EDGE or text[b - 1].isspace()):
        b -= 1
    return a, b


def _candidates(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, start and end of its run) of each run of neighbouring words with a digit or @, and of its single words.

    Known entities are cut out: what stands beside them makes runs of its own.
    """
    runs: list[list[int]] = []
    for m in _MARK.finditer(text):
        a = b = m.start()
        if runs and a < runs[-1][1]:
            continue
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if runs and a - runs[-1][1] == 1 and text[a - 1] == " ":
            runs[-1][1] = b
        else:
            runs.append([a, b])
    spans: list[list[int]] = []
    for _, a, b in known:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    pieces, k = [], 0
    for a, b in runs:
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        while k < len(spans) and spans[k][0] < b:
            pieces.append((a, spans[k][0]))
            a = spans[k][1]
            if a >= b:
                break
            k += 1
        pieces.append((a, b))
    out = []
    for a, b in pieces:
        a, b = _trimmed(text, a, b)
        if a < b and _named(text[a:b]):
            out.append((a, b, a, b))
            for m in _WORD.finditer(text, a, b):
                x, y = _trimmed(text, *m.span())
                if (x, y) != (a, b) and _named(text[x:y]):
                    out.append((x, y, a, b))
    return out


def identifiers(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of neighbouring words with a digit or @, and their single words, without the known entities."""
    return [(a, b) for a, b, _, _ in _candidates(text, known)]


def secret_seed(text: str, a: int, b: int) -> bool:
    """Whether a span looks like a key: long, random and quoted behind an assignment."""
    if b - a < SECRET_CHARS or not _SECRET.fullmatch(text, a, b) or not _ASSIGNED.search(text, max(0, a - 5), a) or text[b:b + 1] != text[a - 1]:
        return False
    counts, n = Counter(text[a:b]), b - a
    return sum(c * math.log2(n / c) for c in counts.values()) >= SECRET_BITS * n


def shape(value: str) -> str:
    """Class of a value's characters, with its length in steps of a half power of two."""
    kind = next((name for at, name in _SHAPES if at.fullmatch(value)), "other")
    return f"{kind}/{round(2 * math.log2(len(value)))}"


class Contexts:
    """The lexical patterns around spans of a text: two words before; one before and one after.

    Words are whole. Of the word that a span stands in, the part next to the
    span counts, up to the next known entity. A long word goes by its digest.
    """

    def __init__(self, text: str, known: list[tuple[str, int, int]]):
        self.text, self.names = text, {}
        words = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in words], [b for _, b in words]
        self.known_starts, self.known_ends = sorted(a for _, a, _ in known), sorted(b for _, _, b in known)

    def _name(self, a: int, b: int) -> str:
        if b - a <= LONG_WORD:
            return self.text[a:b].strip(_EDGE).lower()
        if (a, b) not in self.names:
            self.names[a, b] = md5(self.text[a:b].strip(_EDGE).lower().encode("utf-8", "surrogatepass")).hexdigest()
        return self.names[a, b]

    def of(self, start: int, end: int) -> list[str]:
        j, left = bisect_left(self.starts, start), []
        for i in (j - 2, j - 1):
            if i < 0:
                left.append("")
            elif self.ends[i] <= start:
                left.append(self._name(self.starts[i], self.ends[i]))
            else:
                n = bisect_right(self.known_ends, start)
                left.append(self._name(max(self.starts[i], self.known_ends[n - 1] if n else 0), start))
        r, right = bisect_right(self.ends, end), ""
        if r < len(self.ends):
            a, b = self.starts[r], self.ends[r]
            if a < end:
                n = bisect_left(self.known_starts, end)
                a, b = end, min([b, *self.known_starts[n:n + 1]])
            right = self._name(a, b)
        out = [f"{left[0]} {left[1]} _", f"{left[1]} _ {right}"]
        mark = self._mark(start)
        if mark:
            out.append(f"{mark} <{shape(self.text[start:end])}>")
            if not left[1] and j > 2 and self.ends[j - 1] > start:  # quoted: the words before the quote
                out.append(f"{self._name(self.starts[j - 3], self.ends[j - 3])} {left[0]} _")
        return out

    def _mark(self, at: int) -> str:
        """The punctuation with an assignment sign in it that stands before a place, spaces left out."""
        a = at
        while a > max(0, at - 8) and not self.text[a - 1].isalnum():
            a -= 1
        mark = "".join(self.text[a:at].split())
        return mark if "=" in mark or ":" in mark else ""


def _sights(text: str, known: list[tuple[str, int, int]]) -> list[dict]:
    """Every known entity and candidate with its patterns; a word's patterns that are its run's too do not count twice."""
    at, out = Contexts(text, known), []
    for kind, a, b, ra, rb in [(k, a, b, a, b) for k, a, b in known] + [(None, *x) for x in _candidates(text, known)]:
        inner = (a, b) != (ra, rb)
        outer = at.of(ra, rb) if inner else []
        out.append({"kind": kind, "seed": kind or (SECRET if secret_seed(text, a, b) else None), "start": a, "end": b, "value": text[a:b].lower(), "run": ra, "inner": inner,
                    "patterns": [{"pattern": p, "counts": p not in outer} for p in at.of(a, b)]})
    return out


_SPAN = "struct<kind:string,start:int,end:int>"
#: What names a text: two hashes and its length.
TEXT = ["text_hash", "text_hash2", "n_chars"]
_FOUND = f"doc_id long, text_hash long, text_hash2 long, n_chars int, base array<{_SPAN}>, seen array<struct<kind:string,seed:string,start:int,end:int,value:string,run:int,inner:boolean,patterns:array<struct<pattern:string,counts:boolean>>>>"


def _scan(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("kind", pa.string()), ("seed", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("run", pa.int32()), ("inner", pa.bool_()),
                      ("patterns", pa.list_(pa.struct([("pattern", pa.string()), ("counts", pa.bool_())])))])
    for batch, texts in slices(batches):
        bases, sights = [], []
        for t in texts:
            text = t.decode() if t else ""
            base = entities(text)
            marked = bool(base) or _MARK.search(text)
            bases.append([dict(zip(("kind", "start", "end"), x)) for x in base])
            sights.append(_sights(text, base) if marked else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(bases, pa.list_(span)), pa.array(sights, pa.list_(seen))],
                                         names=["doc_id", *TEXT, "base", "seen"])


def scores(seen: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(value, kind, score) of the identifiers in ``seen`` (seed, value, patterns).

    Seeds count as known with score 1 in every round, and so they end, but for
    those of secrets: a secret's score is what the patterns say of it. Sums are
    rounded before they meet a bound, so reruns agree.
    """
    edges = seen.select(F.explode("patterns").alias("p"), "value").groupBy("p.pattern", "value").agg(F.max("p.counts").alias("counts"))
    edges = stored(edges, "pii-edges")
    sizes = stored(edges.groupBy("pattern").agg(F.count_if("counts").alias("n")), "pii-patterns")
    seeds = stored(seen.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    known = reached = seeds
    for _ in range(rounds):
        support = edges.join(known, "value").groupBy("pattern", "kind").agg(F.round(F.sum("score"), 6).alias("support"))
        good = (support.where(F.col("support") >= min_support).join(sizes, "pattern")
                .withColumn("confidence", F.round(F.col("support") / F.col("n"), 6)).where(F.col("confidence") >= min_confidence))
        # Noisy-or; a pattern is never quite certain.
        reached = stored(edges.join(good, "pattern").groupBy("value", "kind")
                         .agg(F.round(1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.95))))), 6).alias("score")), "pii-scores")
        known = reached.join(seeds.select("value"), "value", "left_anti").unionByName(seeds)
    if not rounds:
        return seeds
    own = seeds.where(F.col("kind") == SECRET).select("value")
    return known.join(own, "value", "left_anti").unionByName(reached.join(own, "value", "left_semi"))


def extract(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, ``base`` and ``added`` spans (kind, start, end) of every whole text.

    ``base`` are the rules' matches; ``added`` never overlap them or each other. Spans are in
    code points, end exclusive, by start, then kind as listed.

    A null or empty text has no spans. Repeated rows each get a row with the
    same spans, null doc_ids stay, other columns are ignored, an empty table
    gives no rows. Without seeds nothing is added.
    """
    text = F.col("text")
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.xxhash64(F.lit(1), text).alias("text_hash2"), F.coalesce(F.length(text), F.lit(-1)).alias("n_chars"))
    found = stored(map_texts(rows, _scan, _FOUND), "pii")
    seen = found.select(*TEXT, F.explode("seen").alias("s")).select(*TEXT, "s.*").distinct()
    best = (scores(seen, rounds).where(F.col("score") >= min_score).groupBy("value")
            .agg(F.max_by("kind", F.struct("score", "kind")).alias("as_kind")))
    # Of a run and its words, the run is added if it can be.
    whole = F.max(~F.col("inner")).over(Window.partitionBy(*TEXT, "run"))
    new = seen.where("kind IS NULL").join(best, "value").withColumn("whole", whole)
    new = (new.where(~F.col("inner") | ~F.col("whole")).groupBy(*TEXT)
           .agg(F.collect_set(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("added")))
    # Written before the join: Spark splits the copies of a text only where both sides are plain shuffles.
    out = found.select("doc_id", *TEXT, "base").join(stored(new, "pii-added"), TEXT, "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")).alias("added"))


def joined(spans) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
