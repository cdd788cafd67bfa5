"""Personal data by a semi-Markov conditional random field over whole candidate spans, beside fixed base patterns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, small_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, EPOCHS, TRAIN_ZONES, SAMPLE_DOCS, SEED = 24, 6, 500, 4000, 11

# The base patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: IP, tried only where a run of digits begins: later starts in a run fail as its first does, so long runs take one try.
_IP_SCAN = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT, _TRIGGER = re.compile("[0-9]"), re.compile("[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|[\W\d_]")
_LOCAL_PHONE = re.compile(r"(\+?[0-9]{1,3}[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _count(s: str) -> int:
    return sum("0" <= c <= "9" for c in s)


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    return 13 <= _count(s) <= 19 and luhn("".join(c for c in s if "0" <= c <= "9"))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, found from each at sign: linear even in one endless word."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            yield m.start(), m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, not overlapping within a kind; failing matches are dropped."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP_SCAN.finditer(text) if _is_ip(m[0])]
        found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= _count(m[0]) <= 15]
    return found


N_FEATURES = 30


def span_features(s: str, left: str, right: str) -> np.ndarray:
    """Features of one whole candidate span and the characters beside it."""
    n = _count(s)
    kinds = {("d" if c.isdigit() else "a" if c.isalpha() else c) for c in s}
    groups = re.findall("[0-9]+", s)
    plain = kinds <= {"d", " ", "-"}
    glued = lambda c: c.isalnum() or c in "_@%+-/=\""
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1] = "@" in s and EMAIL.fullmatch(s) is not None
    f[2] = s.count(".") == 3 and IP.fullmatch(s) is not None and _is_ip(s)
    f[3] = plain and n >= 13 and CARD.fullmatch(s) is not None and _is_card(s)
    f[4] = s[0] == "+" and PHONE.fullmatch(s) is not None and 9 <= n <= 15
    f[5] = _LOCAL_PHONE.fullmatch(s) is not None
    f[6], f[7] = "@" in s, "a" in kinds
    f[8], f[9], f[10], f[11], f[12] = n == 16, 13 <= n <= 19, 9 <= n <= 15, n < 9, n > 19
    f[13], f[14], f[15], f[16], f[17] = " " in s, s.count(" ") >= 3, s.count(".") == 3, "." in s, s[0] == "+"
    f[18] = len(kinds & {" ", "-", "."}) > 1
    f[19], f[20] = glued(left), glued(right)
    f[21], f[22] = left in "0123456789", right in "0123456789"
    f[23] = len({len(g) for g in groups[:-1]}) > 1
    f[24], f[25] = plain and len(groups) == 1, plain and len(groups) > 1 and all(len(g) == 4 for g in groups)
    f[26] = bool(kinds - {"d", "a", " ", "-", ".", "(", ")", "+", "@", "%", "_"})
    f[27], f[28] = len(groups) > 4, s[-1] in ".-(" or s[0] in ".-)"
    f[29] = plain and 13 <= n <= 19 and not f[3]
    return f


def _tokens(zone: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(zone)]


def _candidates(zone: str, tokens: list[tuple[int, int]] | None = None, first: int = 0, last: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Tokens, candidate segments (first token, end token) of at most MAX_TOKENS tokens, and their features.

    Segments begin at tokens ``first`` to ``last`` (all), so that a long zone can be taken slab by slab.
    """
    tokens = _tokens(zone) if tokens is None else tokens
    segments, rows = [], []
    for i in range(first, len(tokens) if last is None else min(last, len(tokens))):
        a = tokens[i][0]
        if zone[a].isspace() or zone[a] in ".,;:!?)":
            continue
        digits, at = 0, False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            x, b = tokens[j - 1]
            c = zone[x]
            if c == "\n":
                break
            at |= c == "@"
            if "0" <= c <= "9":
                digits += b - x
            if not zone[b - 1].isalnum() or digits < 4 and not at:
                continue
            segments.append((i, j))
            rows.append(span_features(zone[a:b], zone[a - 1] if a else " ", zone[b] if b < len(zone) else " "))
    return tokens, segments, np.array(rows).reshape(-1, N_FEATURES)


class SemiMarkov:
    """weights: kind x feature for segments; outside: score of a token in no entity, by token class."""

    def __init__(self, weights: np.ndarray | None = None, outside: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), N_FEATURES)) if weights is None else weights
        self.outside = np.zeros(3) if outside is None else outside

    @staticmethod
    def _class(zone: str, token: tuple[int, int]) -> int:
        c = zone[token[0]]
        return 0 if "0" <= c <= "9" else 1 if c == "@" else 2

    def best(self, zone: str, slab: int = 512) -> list[tuple[int, int, int]]:
        """The best segmentation: (kind, start, end) of its entities, by dynamic programming over bounded segments.

        Each prefix's best score is pushed on to the ends of the segments that begin there, ``slab`` tokens' segments at
        a time, so a zone of any length holds only its tokens and one slab of features. Of equals, no entity wins.
        """
        tokens = _tokens(zone)
        n = len(tokens)
        total, came = [-math.inf] * (n + 1), [(-1, -1)] * (n + 1)
        total[0] = 0.0
        for first in range(0, n, slab):
            _, segments, x = _candidates(zone, tokens, first, first + slab)
            scores = x @ self.weights.T
            kind, value = (scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()) if segments else ([], [])
            s = 0
            for i in range(first, min(first + slab, n)):
                v = total[i] + self.outside[self._class(zone, tokens[i])]
                if v >= total[i + 1]:
                    total[i + 1], came[i + 1] = v, (-1, -1)
                while s < len(segments) and segments[s][0] == i:
                    j = segments[s][1]
                    v = total[i] + value[s]
                    if v > total[j]:
                        total[j], came[j] = v, (i, kind[s])
                    s += 1
        out, j = [], n
        while j:
            i, k = came[j]
            if i >= 0:
                out.append((k, tokens[i][0], tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def fit(self, zones: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = SEED, ridge: float = 1e-4) -> SemiMarkov:
        """Conditional likelihood by forward and backward sums over segmentations, with Adagrad steps."""
        rng, made = random.Random(seed), []
        for zone, truth in zones:
            tokens, segments, x = _candidates(zone)
            place = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j) in enumerate(segments)}
            gold = [(place[a, b], k) for k, a, b in truth if (a, b) in place]
            if len(gold) == len(truth):
                made.append(([self._class(zone, t) for t in tokens], segments, x, gold))
        sum_w, sum_o = np.full_like(self.weights, 1e-2), np.full(3, 1e-2)
        for _ in range(epochs):
            rng.shuffle(made)
            for classes, segments, x, gold in made:
                n = len(classes)
                scores = x @ self.weights.T
                top = scores.max(axis=1) if len(segments) else np.zeros(0)
                joint = top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) if len(segments) else top
                ending, starting = {}, {}
                for s, (i, j) in enumerate(segments):
                    ending.setdefault(j, []).append(s)
                    starting.setdefault(i, []).append(s)
                add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
                fore, back = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    v = fore[j - 1] + self.outside[classes[j - 1]]
                    for s in ending.get(j, ()):
                        v = add(v, fore[segments[s][0]] + joint[s])
                    fore[j] = v
                for i in range(n - 1, -1, -1):
                    v = back[i + 1] + self.outside[classes[i]]
                    for s in starting.get(i, ()):
                        v = add(v, back[segments[s][1]] + joint[s])
                    back[i] = v
                z = fore[n]
                grad_o = np.zeros(3)
                covered = np.zeros(n, bool)
                for s, _ in gold:
                    covered[segments[s][0] : segments[s][1]] = True
                for j in range(n):
                    grad_o[classes[j]] += (not covered[j]) - math.exp(min(0.0, fore[j] + self.outside[classes[j]] + back[j + 1] - z))
                grad_w = np.zeros_like(self.weights)
                if len(segments):
                    at = np.array(segments)
                    mass = np.exp(np.minimum(0, np.array(fore)[at[:, 0]] + np.array(back)[at[:, 1]] - z)[:, None] + scores)
                    grad_w -= mass.T @ x
                    for s, k in gold:
                        grad_w[k] += x[s]
                grad_w -= ridge * self.weights
                sum_w += grad_w**2
                sum_o += grad_o**2
                self.weights += 0.5 * grad_w / np.sqrt(sum_w)
                self.outside += 0.5 * grad_o / np.sqrt(sum_o)
        return self


def _entity(kind: int, rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    if kind == 0:
        return f"{w(2, 9)}{rng.choice(['', '.' + d(2), '_' + w(2, 5), '.' + w(2, 6)])}@{w(3, 8)}{rng.choice(['', d(1)])}.{rng.choice(['', w(3, 7) + '.'])}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    if kind == 1:
        return ".".join(str(rng.randint(1, 254)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", "", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4)) if sep else full
    body = f"{d(3)}", f"{d(3)}", f"{d(4)}"
    return rng.choice(["+1 ({}) {}-{}", "+1 {} {} {}", "+49 {} {}{}", "+1-{}-{}-{}", "({}) {}-{}", "+33 {}.{}.{}"]).format(*body)


def _not_entity(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    long = d(rng.randint(13, 19))
    wrong = long if not luhn(long) else long[:-1] + str((int(long[-1]) + 1) % 10)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 20, 40])))
    return rng.choice([wrong, wrong, hexes, f"password={hexes}", f'"{hexes}"', f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(2)}", d(4), d(2), f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)}-{d(4)}", f"{d(2)}:{d(2)}", f"{d(3)},{d(3)}.{d(2)}", "@" + "abcde"[: rng.randint(1, 5)], f"a{d(5)}@b", d(rng.randint(5, 12))])


def training_zones(real: list[str], zones: int = TRAIN_ZONES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Half: entities and look-alikes made by rule, alone or side by side. Half: zones of real texts in which base spans lie apart."""
    rng, out = random.Random(seed), []
    for _ in range(zones):
        text, truth = "", []
        for i in range(rng.choice([1, 1, 2, 2, 3])):
            text += rng.choice([" ", " ", " ", ", ", "; "]) if i else ""
            if rng.random() < 0.6:
                k = rng.randrange(4)
                s = _entity(k, rng)
                truth.append((k, len(text), len(text) + len(s)))
            else:
                s = _not_entity(rng)
            text += s
        out.append((text + rng.choice(["", "", ".", ","]), truth))
    for text in real:
        for a, b in zones_of(text):
            zone = text[a:b]
            truth = sorted(base_spans(zone), key=lambda t: t[1])
            if len(zone) <= 200 and len(truth) <= 1:
                digits = sum(_count(zone[x:y]) for _, x, y in truth)
                if _count(zone) == digits or not truth and _count(zone) < 9:  # nothing else in it may be an entity
                    out.append((zone, truth))
            if len(out) >= 2 * zones:
                return out
    return out


def zones_of(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring words that hold a digit or an at sign."""
    n, end, start = len(text), 0, None
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():  # back to the word's start, at most once over each character
            a -= 1
        b = m.end()
        while b < n and not text[b].isspace():
            b += 1
        if start is not None and a - end <= 1 and text[end:a] in ("", " "):
            end = b
            continue
        if start is not None:
            yield start, end
        start, end = a, b
    if start is not None:
        yield start, end


def find_spans(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans the model adds: those of its best segmentation of what base spans leave free."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, []
    added = []
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for a, b in zones_of(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        free, i, k = a, at, 0
        gaps = []
        while i < len(taken) and taken[i][0] < b:
            gaps.append((free, max(free, taken[i][0])))
            free = max(free, taken[i][1])
            i += 1
        gaps.append((free, b))
        for x, y in gaps:
            gap = text[x:y]
            if _count(gap) >= 4 or "@" in gap:
                added += [(k, x + s, x + e) for k, s, e in model.best(gap)]
    return base, added


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> SemiMarkov:
    """Fits on made zones and on zones of about ``sample`` documents, those with the lowest hashes of their identifier.

    Of each, at most 20 zones of a text of under 20,000 code points reach the driver; ``fit`` uses TRAIN_ZONES of them.
    """
    words = "'[^\\\\s]*[0-9@][^\\\\s]*( [^\\\\s]*[0-9@][^\\\\s]*)*'"
    some = hash_sample(docs, id_col, sample).select(whole_text(text_col).alias("t")).filter(F.col("t").rlike("[0-9@]") & (F.length("t") < 20_000))
    rows = some.select(F.expr(f"slice(regexp_extract_all(t, {words}, 0), 1, 20)").alias("z")).collect()
    return SemiMarkov().fit(training_zones([z for r in sorted(rows) for z in r.z]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 are of base spans; ``spans`` lists base and added ones by kind and start, in code points,
    end exclusive; n_added counts the added ones. A null text is empty: no spans, and the hash of the empty string.
    Repeated rows are answered each; a null identifier stays null; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, added = find_spans(text.as_py(), model)
                counts = [sum(k == i for k, _, _ in base) for i in range(4)]
                rows.append((doc, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (5, 6) else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def mask_text(text: str, model: SemiMarkov) -> str:
    """The text with every found span replaced by its kind in angle brackets; overlapping spans become one."""
    base, added = find_spans(text, model)
    out, end, i = [], 0, 0
    spans = sorted(base + added, key=lambda t: (t[1], -t[2]))
    while i < len(spans):
        k, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = b
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, model: SemiMarkov, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text masked; null texts stay null. All other columns pass unchanged."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else mask_text(t, model) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op4_semi_markov_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, train(docs))
