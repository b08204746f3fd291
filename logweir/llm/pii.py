"""Personal data by a semi-Markov conditional random field over patterns that stay.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Where they leave tokens with digits
or an at sign unexplained, a semi-Markov CRF scores candidate segments of at most `LONGEST` atoms by features of
the whole span and chooses boundaries and types jointly by dynamic programming. It is trained on the base spans of
a bounded sample, on variants of them that the patterns do not match (no country code, dotted groups) and on made-up
forms: mail addresses with accents or underscores after the sign, IPv6, cards in other groups, local phone numbers, and look-alikes that are none.

Null texts count as empty; places are code points, the end exclusive. Texts are read whole; repeated rows are
labelled each for itself.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import documents, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Atoms in a segment at most; documents that a fit reads at most.
LONGEST, SAMPLE = 40, 3000
#: Written forms that a fit makes up, of each kind and of none.
MADE = 60
_HEX = frozenset("0123456789abcdefABCDEF")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9][\x20().0-9+-]*")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Code points from which on a zone is cut at its next blank: bounds what a lattice holds.
ZONE = 400
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            found.append((0, s, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for run in _RUN.finditer(text):
        s, e = run.span()
        if s and text[s - 1] == "+":
            s -= 1
        if e - s < 7:
            continue
        if text.count(".", s, e) > 2:
            found += [(1, a, b) for a, b in _addresses(text, s, e)]
        for m in _CARD.finditer(text, s, e):
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                found.append((2, *m.span()))
        for m in _PHONE.finditer(text, s, e):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return sorted(found)


def _addresses(text: str, s: int, e: int):
    """Four groups of digits with single dots between them, none above 255; a match that fails is passed over whole."""
    groups = [m.span() for m in _DIGITS.finditer(text, s, e)]
    k = 0
    while k + 3 < len(groups):
        if all(text[groups[i][1]] == "." and groups[i + 1][0] == groups[i][1] + 1 for i in range(k, k + 3)):
            parts = [text[a:b] for a, b in groups[k : k + 4]]
            if all(not p[:-3].strip("0") and int(p[-3:]) <= 255 for p in parts):
                yield groups[k][0], groups[k + 3][1]
            k += 4
        else:
            k += 1


def zones(text: str):
    """(start, end) of tokens with a digit or an at sign, neighbours with one blank between them taken together."""
    start = end = None
    for m in _TOKEN.finditer(text):
        if start is not None and m.start() == end + 1 and text[end] == " " and end - start < ZONE:
            end = m.end()
            continue
        if start is not None:
            yield start, end
        start, end = m.span()
    if start is not None:
        yield start, end


def _segments(atoms: list[str]) -> list[tuple[int, int]]:
    """Candidates: begin and end at a word border, hold a digit or an at sign, are no longer than `LONGEST`."""
    n = len(atoms)
    word = [a[0].isalnum() for a in atoms]
    begins = [i for i in range(n) if (word[i] or atoms[i] in "+(") and not (i and word[i - 1] and word[i])]
    out = []
    for i in begins:
        good = False
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            good |= atoms[j - 1] == "@" or atoms[j - 1][0].isdigit()
            if good and (word[j - 1] or atoms[j - 1] == ")") and not (j < n and word[j - 1] and word[j]):
                out.append((i, j))
    return out


def _features(atoms: list[str], i: int, j: int) -> list[int]:
    """Numbers of the features that hold of a whole span."""
    span = atoms[i:j]
    s = "".join(span)
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in s)
    groups = [len(a) for a in span if a[0].isdigit()]
    seps = {a for a in span if not a[0].isalnum()}
    parts = s.split(".")
    local, _, domain = s.partition("@")
    last = domain.rsplit(".", 1)[-1]
    tests = (
        True, n == 0, n < 4, 4 <= n <= 6, n == 7, n == 10, n == 11, 8 <= n <= 15, 12 <= n <= 15, 16 <= n <= 19, n > 19,
        n >= 12 and luhn(digits), 16 <= n <= 19 and luhn(digits), 16 <= n <= 19 and not luhn(digits), letters == 0, letters > n,
        len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts), len(parts) == 4, len(parts) > 4,
        s[0] == "+", "(" in seps and ")" in seps, s.count("(") != s.count(")"), "-" in seps, "." in seps, " " in seps, "@" in seps,
        seps <= {" ", "-"}, seps <= {" ", "-", "(", ")", "+", "."}, groups[-2:] == [3, 4], groups[-3:] == [3, 3, 4], groups == [4, 4, 4, 4], len(groups) == 1,
        "@" in s and bool(local) and "." in domain, s.count("@") == 1 and last.isalpha() and len(last) >= 2, s.count("@") == 1 and " " not in s, s.count("@") > 1,
        i > 0 and atoms[i - 1] != " ", j < len(atoms) and atoms[j] != " ", i > 0 and atoms[i - 1] in "+(", i > 0 and atoms[i - 1] in ".-@" , j < len(atoms) and atoms[j] in ".-@(" and j + 1 < len(atoms) and atoms[j + 1][0].isalnum(),
        i > 1 and atoms[i - 1] == " " and atoms[i - 2][0].isdigit(), j + 1 < len(atoms) and atoms[j] == " " and atoms[j + 1][0] in "0123456789(+",
        ":" in seps, "::" in s, 3 <= s.count(":") <= 7, len(seps) == 1 and ":" in seps and letters > 0, seps == {":"} and all(len(g) <= 4 and set(g) <= _HEX for g in s.split(":")),
        "/" in seps, "," in seps, "%" in seps or "$" in seps or "#" in seps, groups == [4, 6, 5], n == 15 and luhn(digits), n == 15, groups[:1] == [4] and groups[1:3] == [2, 2], len(groups) == 3 and letters == 0, len(groups) > 3,
        s.startswith("00") and n >= 10, s.startswith("0") and 9 <= n <= 12, n >= 9 and len(groups) >= 3 and letters == 0, " @ " in s, "_" in seps, groups[:1] == [3] and n == 10,
    )
    return [k for k, t in enumerate(tests) if t]


FEATURES = 63


def _lattice(atoms: list[str]):
    segs = _segments(atoms)
    x = np.zeros((len(segs), FEATURES))
    for r, (i, j) in enumerate(segs):
        x[r, _features(atoms, i, j)] = 1
    return segs, x


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _marginals(n: int, segs: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each labelled segment; an atom outside segments scores 0."""
    into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    whole = [_logsum(list(s)) for s in scores]
    for r, (i, j) in enumerate(segs):
        into[j].append((r, i))
        out[i].append((r, j))
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = _logsum([a[j - 1], *[a[i] + whole[r] for r, i in into[j]]])
    for i in range(n - 1, -1, -1):
        b[i] = _logsum([b[i + 1], *[whole[r] + b[j] for r, j in out[i]]])
    return np.exp(np.array([[a[i] + b[j] - a[n]] for i, j in segs]) + scores) if segs else scores


def decode(atoms: list[str], w: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first atom, atom after the last) of the best labelling."""
    segs, x = _lattice(atoms)
    if not segs:
        return []
    s = x @ w.T
    kind, value = s.argmax(1), s.max(1)
    best, back = [0.0] * (len(atoms) + 1), [-1] * (len(atoms) + 1)
    into: dict[int, list[int]] = {}
    for r, (_, j) in enumerate(segs):
        into.setdefault(j, []).append(r)
    for j in range(1, len(atoms) + 1):
        best[j] = best[j - 1]
        for r in into.get(j, ()):
            v = best[segs[r][0]] + value[r]
            if v > best[j]:
                best[j], back[j] = v, r
    out, j = [], len(atoms)
    while j:
        if back[j] < 0:
            j -= 1
        else:
            i = segs[back[j]][0]
            out.append((int(kind[back[j]]), i, j))
            j = i
    return out[::-1]


def _examples(text: str):
    """(atoms, gold segments) of a text's zones."""
    spans = base_spans(text)
    for s, e in zones(text):
        atoms = _ATOM.findall(text[s:e])
        places = {s: 0}
        at = s
        for k, a in enumerate(atoms):
            at += len(a)
            places[at] = k + 1
        inside = [x for x in spans if x[1] < e and x[2] > s]
        if len(atoms) <= 80 and all(x[1] in places and x[2] in places for x in inside) and all(p[2] <= q[1] for p, q in zip(sorted(inside, key=lambda x: x[1]), sorted(inside, key=lambda x: x[1])[1:])):
            yield atoms, [(k, places[a], places[b]) for k, a, b in inside]


def _variants(atoms: list[str], gold: list[tuple[int, int, int]]):
    """The zone, and forms of a lone phone or card number that the base patterns do not match."""
    yield atoms, gold
    if len(gold) == 1:
        kind, i, j = gold[0]
        if kind == 3 and j - i > 4 and atoms[i] == "+":
            cut = i + 3 if atoms[i + 2] in " -." else i + 1
            yield atoms[:i] + atoms[cut:], [(3, i, j - cut + i)]
        if kind == 2 and j - i == 1 and len(atoms[i]) == 16:
            d = atoms[i]
            dotted = [d[:4], ".", d[4:8], ".", d[8:12], ".", d[12:]]
            yield atoms[:i] + dotted + atoms[j:], [(2, i, i + 7)]


def _checked(digits: str) -> str:
    """The digits with a last one that passes Luhn."""
    return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))


def made_up(rng: random.Random):
    """(kind or None, text) of forms that the patterns do not match, and of look-alikes that are none; without end."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda: f"{rng.randrange(1 << 16):x}"
    w = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7)))
    area = lambda: str(rng.randint(2, 9)) + d(2)
    while True:
        card = _checked(rng.choice("45") + d(14))
        amex = _checked("37" + d(12))
        yield 0, f"{w()}{rng.choice(['', '.', d(2)])}@{w()}{rng.choice('äöüéñ')}{w()}.{rng.choice(['com', 'de', 'io'])}"
        yield 0, f"{w()}.{w()}@{w()}_{w()}.{rng.choice(['com', 'org', 'net'])}"
        yield 1, ":".join(h() for _ in range(rng.randint(5, 8)))
        yield 1, ":".join(h() for _ in range(rng.randint(1, 3))) + "::" + ":".join(h() for _ in range(rng.randint(1, 3)))
        yield 2, rng.choice("._/").join(card[k : k + 4] for k in range(0, 16, 4))
        yield 2, rng.choice([f"{amex[:4]} {amex[4:10]} {amex[10:]}", f"{amex[:4]}-{amex[4:10]}-{amex[10:]}"])
        yield 3, rng.choice([f"({area()}) {area()}-{d(4)}", f"{area()}-{area()}-{d(4)}", f"{area()}.{area()}.{d(4)}", f"{area()} {area()} {d(4)}"])
        yield 3, rng.choice([f"00{rng.randint(30, 49)} {d(3)} {d(6)}", f"0{d(3)} {d(6)}", f"0{d(2)}-{d(7)}"])
        for _ in range(2):
            yield None, rng.choice([f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 40)}", f"v{rng.randint(1, 9)}.{d(1)}", f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{rng.randint(1, 9)}/20{d(2)}"])
            yield None, rng.choice([f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"id {d(7)}"])
            yield None, rng.choice([d(rng.randint(1, 7)), d(rng.randint(20, 30)), f"${d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"#{d(5)}", f"{d(2)}%", f"{w()}{d(3)}", f"{d(4)} {d(4)}", f"{w()}@{w()}"])


def _made_examples(seed: int, n: int):
    """(atoms, gold) of n made-up forms, alone, within a bracket or beside a number."""
    rng = random.Random(seed)
    for kind, text in itertools.islice(made_up(rng), n):
        before, after = rng.choice([("", ""), ("", ""), ("(", ")"), ("", "."), ("", ","), (f"{rng.randint(1, 99)} ", "") if kind is None else ("", "")])
        atoms, lead = _ATOM.findall(before + text + after), len(_ATOM.findall(before))
        yield atoms, [] if kind is None else [(kind, lead, lead + len(_ATOM.findall(text)))]


def fit_texts(texts: list[str], epochs: int = 12, rate: float = 0.5, l2: float = 1e-4, most: int = 1500) -> np.ndarray:
    """Weights by kind and feature, by stochastic gradient on the conditional likelihood; without any span they are zero but for a bias against segments."""
    w = np.zeros((len(KINDS), FEATURES))
    w[:, 0] = -2.0
    data, seen = [], set()

    def learn(a: list[str], g: list[tuple[int, int, int]]) -> None:
        segs, x = _lattice(a)
        at = {s: r for r, s in enumerate(segs)}
        if all((i, j) in at for _, i, j in g):
            y = np.zeros((len(segs), len(KINDS)))
            for k, i, j in g:
                y[at[i, j], k] = 1
            data.append((len(a), segs, x, y))

    for a, g in _made_examples(1, 14 * MADE):
        learn(a, g)
    for t in texts:
        for atoms, gold in _examples(t):
            key = "".join(atoms)
            if key not in seen and len(data) < most:
                seen.add(key)
                for a, g in _variants(atoms, gold):
                    learn(a, g)
    if not any(y.any() for _, _, _, y in data):
        return w
    rng, squares = random.Random(0), np.full_like(w, 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, segs, x, y in data:
            if not segs:
                continue
            g = (_marginals(n, segs, x @ w.T) - y).T @ x + l2 * w
            squares += g * g
            w -= rate * g / np.sqrt(squares)
    return w


def spans_of(text: str, w: np.ndarray, decoded=None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the model adds beside them."""
    base = base_spans(text)
    added = []
    taken = sorted((s, e) for _, s, e in base)
    decoded = decoded or (lambda piece: decode(_ATOM.findall(piece), w))
    k = 0
    for s, e in zones(text):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        at, free, q = s, [], k
        while q < len(taken) and taken[q][0] < e:
            free.append((at, taken[q][0]))
            at = max(at, taken[q][1])
            q += 1
        free.append((at, e))
        for a, b in free:
            if b > a and any(c == "@" or "0" <= c <= "9" for c in text[a:b]):
                piece = text[a:b]
                found = decoded(piece)
                if found:
                    ends = np.cumsum([0] + [len(x) for x in _ATOM.findall(piece)])
                    added += [(kind, a + int(ends[i]), a + int(ends[j])) for kind, i, j in found]
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Fit on at most `SAMPLE` texts that hold a digit or an at sign, chosen by a hash of id and text."""
    rows = docs.select(F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where(F.col("t").rlike("[0-9@]") & F.col("t").isNotNull())
    bound = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h").alias("top")).first()["top"]
    got = sorted(rows.where(F.col("h") <= bound).toLocalIterator(), key=lambda r: (r["h"], r["t"])) if bound is not None else []
    return fit_texts([r["t"] for r in got])


def find(docs: DataFrame, w: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_added, a row for each row of `docs`."""
    small_batches(docs.sparkSession)

    def run(batches):
        cached = lru_cache(1 << 14)(lambda piece: tuple(decode(_ATOM.findall(piece), w)))
        for rows in batches:
            out = []
            for t in rows.column(1).to_pylist():
                base, added = spans_of(t or "", w, cached)
                counts = [sum(k == x[0] for x in base) for k in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), types)]], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, fit(docs))
