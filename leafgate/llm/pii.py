"""Personal data by bootstrapped contextual extraction.

Seeds are found by form: e-mail addresses, IP addresses, payment cards and phone numbers (the base kinds), and secrets
of two public forms (access key ids, hexadecimal digests). Every other token with four digits or an @ is a candidate;
of a token such as name=value the value is. The words and marks around an occurrence, lower-cased and without quotes,
give its lexical patterns: the two before, the one before, the one before with the one after, the two after. Patterns
and instances form a graph, which Spark scores in turns: a pattern by the share of its instances that are believed to
be of a kind, a candidate by the mean score of its patterns. Instances by form count one, for their kind or against it;
candidates count `DAMP`, times their score where they are for it; `DOUBT` instances count against each pattern, so
a pattern needs some ten seeds of hardly more than one kind to be trusted. A candidate that scores `min_score` after
`rounds` turns becomes a span of that kind. Patterns count only with `min_seeds` different seed instances from as many documents. The graph is made of distinct
instances before it is joined, and hot patterns are summed where they are read.

Defined results: a null or empty text has no spans, however long a text is it is read whole; candidates and secrets
that overlap a base span are ignored; a candidate of two kinds takes the higher score, then the first kind in the
order of ALL_KINDS; repeated rows give repeated rows; a null doc_id is a key like others; extra columns are ignored
(query) or passed on whatever their names (stage).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafgate.llm.tables import written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
ROUNDS = 3
MIN_SEEDS = 5
MIN_SCORE = 0.8
#: Weight of what is not known by form, and number of instances that speak against any pattern.
DAMP, DOUBT = 0.5, 2.0
#: The base forms but e-mail, whose local part is sought from its @ to the left. No form goes over a run of characters twice. Fixed values.
FORMS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Seeds of secrets: access key ids, and digests of 32, 40 or 64 lower-case hexadecimal digits. Fixed values.
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}))(?![A-Za-z0-9])")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_ANY = re.compile(r"[0-9@]")
_PIECE = re.compile(r"\w+|[^\w\s]")
_QUOTES = frozenset("\"'`“”‘’«»")
_EDGE = ".,;:!?()[]{}<>\"'#*$%&|=“”‘’«»"
_DIGITS = re.compile(r"[^0-9]")
#: Bytes around an occurrence that are looked at first; more, if they hold no whole pieces. Longer names go by a digest.
_AROUND, _NAME = 96, 80
OCCURRENCE = "key long, twin long, kind string, first int, last int, surface string, patterns array<string>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":  # leading zeros are allowed, any number of them
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 for p in parts) and all(int(p or "0") <= 255 for p in parts)
    digits = _DIGITS.sub("", found)
    return 14 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            done = m.end()
            yield a, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, kind's place in KINDS, end."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for order, kind in enumerate(KINDS):
        if kind in FORMS and (kind != "phone" or "+" in text):
            out += [(m.start(), order, m.end()) for m in FORMS[kind].finditer(text) if valid(kind, m[0])]
    return sorted(out)


class _Taken:
    """Whether ranges, asked for from left to right, touch one of the sorted spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.k, self.end = sorted(spans), 0, 0

    def touch(self, a: int, b: int) -> bool:
        while self.k < len(self.spans) and self.spans[self.k][0] < b:
            self.end = max(self.end, self.spans[self.k][1])
            self.k += 1
        return self.end > a


def secrets(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Seeds of secrets outside taken spans. A digest has digits and letters."""
    base = _Taken([(a, b) for a, _, b in taken])
    return [m.span() for m in SECRET.finditer(text) if _ANY.search(m[0]) and not m[0].isdigit() and not base.touch(*m.span())]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with four digits or an @, without marks at their edges, outside taken spans; of name=value the value."""
    used, out = _Taken(taken), []
    for m in _CANDIDATE.finditer(text):
        word = m[0].rstrip(_EDGE)
        b = m.start() + len(word)
        own = word[word.rfind("=") + 1 :].lstrip(_EDGE)
        a = b - len(own)
        if ("@" in own or len(_DIGITS.sub("", own)) >= 4) and not used.touch(a, b):
            out.append((a, b))
    return out


def _named(piece: str) -> str:
    return piece if len(piece) <= _NAME else hashlib.md5(piece.encode("utf-8", "replace")).hexdigest()


def _pieces(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The two words or marks before and after a:b, whole."""
    sides = []
    for left in (True, False):
        size = _AROUND
        while True:
            part = text[max(0, a - size) : a] if left else text[b : b + size]
            whole = size >= (a if left else len(text) - b)
            found = [p for p in _PIECE.findall(part.lower()) if p not in _QUOTES]
            if whole or len(found) > 2:  # the third may be cut, the two next ones are whole
                break
            size *= 8
        near = found[-2:] if left else found[:2]
        sides.append([_named(p) for p in near])
    return sides[0], sides[1]


def patterns(text: str, a: int, b: int) -> list[str]:
    left, right = _pieces(text, a, b)
    l1, r1 = left[-1] if left else "^", right[0] if right else "$"
    l2 = left[0] if len(left) > 1 else "^"
    r2 = right[1] if len(right) > 1 else "$"
    return [f"{l2} {l1} _", f"{l1} _", f"{l1} _ {r1}", f"_ {r1} {r2}"]


def occurrences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Seeds (kind set) and candidates (kind null) with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OCCURRENCE.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
        for batch in batches:
            rows: list[tuple] = []
            keys, twins = batch.column("key").to_pylist(), batch.column("twin").to_pylist()
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                if not _ANY.search(text):
                    continue
                base = base_spans(text)
                said = [(KINDS[order], a, b) for a, order, b in base] + [("secret", a, b) for a, b in secrets(text, base)]
                said += [(None, a, b) for a, b in candidates(text, [(a, b) for _, a, b in said])]
                for kind, a, b in said:
                    rows.append((keys[i], twins[i], kind, a, b, _named(text[a:b].lower()), patterns(text, a, b)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("twin"), "text").mapInArrow(run, OCCURRENCE)


def _order(kind: F.Column) -> F.Column:
    return F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind)


def discovered(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """Candidate surfaces believed to be of a kind: surface, kind, score. found: occurrences."""
    pairs = found.select("kind", "surface", "key", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = pairs.groupBy("pattern", "surface", "kind").agg(F.min("key").alias("doc"))  # copies of a text add nothing
    # a pattern without enough different seeds of one kind can never be believed
    seeded = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.approx_count_distinct("doc").alias("docs"))
    able = seeded.where((F.col("seeds") >= min_seeds) & (F.col("docs") >= min_seeds)).select("pattern").distinct()
    edges = written(edges.drop("doc").join(able, "pattern", "left_semi"), "pii-edges")
    rooms = edges.groupBy("pattern").agg((F.sum(F.when(F.col("kind").isNull(), DAMP).otherwise(1.0)) + DOUBT).alias("room"))
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("mass"))
    open_edges = edges.where("kind is null").select("pattern", "surface")
    believed = None
    for _ in range(rounds):
        known = seeds
        if believed is not None:
            added = open_edges.join(believed, "surface").groupBy("pattern", "kind").agg((DAMP * F.sum("score")).alias("mass"))
            known = seeds.unionByName(added).groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        trusted = known.join(rooms, "pattern").select("pattern", "kind", (F.col("mass") / F.col("room")).alias("trust"))
        mine = open_edges.groupBy("surface").agg(F.count("*").alias("n"))
        scored = open_edges.join(trusted, "pattern").groupBy("surface", "kind").agg(F.sum("trust").alias("trust")).join(mine, "surface")
        best = F.max_by(F.struct("kind", (F.col("trust") / F.col("n")).alias("score")), F.struct(F.col("trust"), -_order(F.col("kind"))))
        believed = written(scored.groupBy("surface").agg(best.alias("b")).select("surface", "b.kind", "b.score"), "pii-beliefs")
    return believed.where(F.col("score") >= min_score)


def spans(docs: DataFrame, **how) -> DataFrame:
    """Spans of documents that have any: key, twin, kind, first, last, base (of a base kind, by form)."""
    found = written(occurrences(docs), "pii")
    seeds = found.where("kind is not null").select("key", "twin", "kind", "first", "last", (F.col("kind") != "secret").alias("base"))
    new = found.where("kind is null").join(discovered(found, **how).select("surface", F.col("kind").alias("k")), "surface")
    return seeds.unionByName(new.select("key", "twin", F.col("k").alias("kind"), "first", "last", F.lit(False).alias("base"))).distinct()


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_discovered (spans that the method added)."""
    one = F.struct(F.col("first"), _order(F.col("kind")).alias("o"), F.col("last"), F.col("base"), F.concat_ws(":", "kind", "first", "last").alias("said"))
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    by = spans(docs, **how).groupBy("key", "twin").agg(*counts, F.count_if(~F.col("base")).alias("n_discovered"), F.array_sort(F.collect_list(one)).alias("all"))
    said = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    by = by.select("key", "twin", *(f"n_{k}" for k in KINDS), "n_discovered", said(F.filter("all", lambda x: x["base"])).alias("base"), said(F.col("all")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_twin"))
    out = rows.join(by, rows.doc_id.eqNullSafe(by.key) & (rows._twin == by.twin), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *(number(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), number("n_discovered"))


def redacted(docs: DataFrame, **how) -> DataFrame:
    """docs with each span replaced by its kind in brackets; columns and rows otherwise unchanged."""
    one = F.struct(F.col("first").alias("a"), F.col("last").alias("b"), F.upper("kind").alias("kind"))
    by = spans(docs, **how).groupBy("key", "twin").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    # the caller's columns travel under names of their own, which can't clash with those below
    own = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    key, text = (own[f"_c{docs.columns.index(c)}"] for c in ("doc_id", "text"))
    at = docs.columns.index("text")
    rows = own.join(by, key.eqNullSafe(by.key) & (F.xxhash64(text) == by.twin), "left").select(*own.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(at).to_pylist(), batch.column("spans")
            for i in range(batch.num_rows):
                if marks[i].is_valid:
                    text, out, done = texts[i], [], 0
                    for s in marks[i].as_py():
                        if s["b"] > done:
                            out += [text[done : max(done, s["a"])], f"[{s['kind']}]"] if s["a"] >= done else []
                            done = s["b"]
                    texts[i] = "".join([*out, text[done:]])
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    renamed = rows.mapInArrow(run, own.schema)
    return renamed.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
