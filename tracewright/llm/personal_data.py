"""Personal data: fixed patterns for four kinds, and a linear-chain conditional random field that adds further spans.

Patterns (base kinds email, ip, card, phone) are found exactly as a left-to-right scan would find them, but the scan only
visits stretches that can hold a match. The field labels the tokens of each line with O, name, ssn or secret from word
shapes and neighbouring words. It is trained on a small labelled table (:func:`labelled_rows`) with the forward-backward
algorithm, and decoded with the Viterbi algorithm for all lines of a batch at once in numpy. A token's share of the scores
depends on the token alone, so distinct tokens are scored once per task. Spans of the field are cut where they meet base
spans, which always stay.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, memo_bytes, pa_fields, slices, task_state, texts_of

BASE = ("email", "ip", "card", "phone")
LABELS = ("O", "name", "ssn", "secret")
KINDS = (*BASE, *LABELS[1:])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: labels of a domain; no shorter way to match it exists, so nothing is tried twice
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: all matches but those of emails lie within such stretches
_NUMBER_RUN = re.compile(r"[0-9+][\x20().0-9+-]*+")
#: digit runs with single full stops between them
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_RUN = re.compile("[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            begin = at
            while begin > floor and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield "email", begin, m.end()
                floor = m.end()
        floor = max(floor, at + 1)
        at = text.find("@", floor)


def _addresses(text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    for chain in _DOTTED.finditer(text, a, b):
        parts = list(_DIGIT_RUN.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):  # matches don't overlap, so they take four runs each
            four = parts[i : i + 4]
            if all(len(x := m[0].lstrip("0")) < 3 or (len(x) == 3 and x <= "255") for m in four):
                yield "ip", four[0].start(), four[3].end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed in ``BASE``, then by start; in time that grows with the length of the text."""
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in BASE}
    found["email"] += _emails(text)
    for run in _NUMBER_RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        found["ip"] += _addresses(text, a, b)
        for m in _CARD.finditer(text, a, b):
            if m.end() - m.start() <= 2 * 19:
                digits = re.sub("[^0-9]", "", m[0])
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found["phone"].append(("phone", m.start(), m.end()))
    return [s for k in BASE for s in found[k]]


# ---- the labelled table -------------------------------------------------------------------------------------------

_GIVEN = "Anna Bruno Carla David Elena Felix Greta Hugo Irene Jonas Karin Luis Marta Nina Oscar Paula Rosa Simon Teresa Victor Marie Pierre Juan Lucia Hans Ingrid".split()
_FAMILY = "Alvarez Becker Costa Dubois Evans Fischer Garcia Hoffmann Jensen Keller Lopez Moreau Novak Olsen Perez Richter Santos Torres Vogel Weber Smith Johnson Martin Bernard".split()
_CUES = ["my name is", "name:", "Name:", "Mr.", "Mrs.", "Ms.", "Dr.", "signed by", "contact person", "Contact:", "patient", "Customer:"]
_SSN_CUES = ["SSN", "SSN:", "social security number", "tax id", "ssn is"]
_SECRET_CUES = ["password =", "password:", "token =", "api_key =", "secret:", "secret =", "key ="]
_MARKS = ["###", "***", "$$$", "%%%", "&&&", "!!"]


def labelled_rows(seed: int = 11, sentences: int = 1200) -> list[tuple[int, int, str, str]]:
    """The small labelled table: (sentence, position, token, label), made by rule from short lists and made-up words.

    Half of the names are made up, so that their neighbours and shapes have to tell them. Emails, addresses, card and
    phone numbers, which the patterns find, are labelled O.
    """
    rng = random.Random(seed)
    syllable = "an er in th on ti re ha st en be la de ou le um ra zu con que".split()
    made_up = lambda least: "".join(rng.choice(syllable) for _ in range(rng.randint(least, 4)))
    rows: list[tuple[int, int, str, str]] = []

    def filler(n: int, loud: bool) -> list[tuple[str, str]]:
        out = []
        for _ in range(n):
            w = made_up(1)
            form = rng.random()
            w = w.capitalize() if form < 0.15 else w.upper() if form < 0.18 else w
            w = str(rng.randrange(10 ** rng.randint(1, 8))) if form > 0.96 else w
            w += rng.choice(_MARKS) if loud else rng.choice(["", "", "", "", ".", ",", "!"])
            out.append((w, "O"))
        return out

    def number(least: int, most: int) -> str:
        return str(rng.randrange(10**least, 10**most))

    for s in range(sentences):
        loud = rng.random() < 0.08
        body = filler(rng.randint(0, 8), loud)
        what = rng.random()
        if what < 0.3:
            name = [(rng.choice(own) if rng.random() < 0.5 else made_up(2).capitalize(), "name") for own in (_GIVEN, _FAMILY)]
            name[1] = (name[1][0] + rng.choice(["", "", ".", ","]), "name")
            body += [(c, "O") for c in rng.choice(_CUES).split()] + name[rng.random() < 0.3 :]
        elif what < 0.42:
            ssn = f"{rng.randrange(100, 900)}-{rng.randrange(10, 100)}-{rng.randrange(1000, 10000)}"
            body += [(c, "O") for c in rng.choice(_SSN_CUES).split()] * (rng.random() < 0.8) + [(ssn, "ssn")]
        elif what < 0.62:
            kind = rng.random()
            key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40)))
            if kind < 0.2:
                body += [("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "secret")]
            elif kind < 0.4:
                body += [(rng.choice(["password=", "secret=", "token="]) + key, "secret")]
            else:
                mark = rng.choice(_MARKS) if loud else ""
                cue = rng.choice(_SECRET_CUES).split()
                body += [(c + mark * (c.isalpha()), "O") for c in cue] + [(f'"{key}"{mark}' if rng.random() < 0.7 else key + mark, "secret")]
        elif what < 0.9:  # look-alikes that are none
            email = f"{made_up(1)}.{rng.randrange(100)}@{made_up(1)}{rng.randrange(10)}.example.com"
            phone = ["+1", f"({rng.randrange(1000):03d})", f"{rng.randrange(1000):03d}-{rng.randrange(10000):04d}"]
            alike = [["12-05-2021"], ["1999-2004"], [number(15, 16)], ["is", number(15, 16)], [made_up(1).capitalize()] * rng.randint(4, 14), ["|", "And", "|"], ["to.", "By", "|"], ["Street", "Market"], ["anderathend."], ["key", "words"], ["SCUM!!", "TION!!"], [email], [email], [email.replace(".", ".the.", 1)], [".".join(str(rng.randrange(256)) for _ in range(4))], phone, [f"https://{made_up(1)}.example.org/{made_up(2)}/{number(3, 6)}"], [made_up(3) + made_up(3) + made_up(3)]]
            body += [(t, "O") for t in rng.choice(alike)]
        body += filler(rng.randint(0 if body else 1, 8), loud)
        rows += [(s, i, t, label) for i, (t, label) in enumerate(body)]
    return rows


# ---- the field ----------------------------------------------------------------------------------------------------


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as X, x, d with their length class; other characters as they are."""
    out = []
    for m in re.finditer(r"[A-Z]+|[0-9]+|[^\W\d_A-Z]+|.", token, re.S):
        c, n = m[0][0], len(m[0])
        kind = "X" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "x" if c.isalpha() else c
        out.append(kind + (str(n) if n < 5 else "+" if n < 16 else "*") if kind in "Xd" else kind)
        if len(out) == 12:
            break
    return "".join(out)


def features(token: str) -> list[str]:
    """Features of a token by itself: the word (its first 24 characters; only where training has met them), its shape (the
    first 12 runs), its last character if that is a mark, its kinds of characters, and what stands around = and :."""
    kinds = sum((bool(re.search(p, token)) for p in ("[0-9]", "[a-z]", "[A-Z]")))
    mixed = len(re.sub(r"[^0-9A-Za-z]", "", token)) >= 16 and bool(re.search("[0-9]", token))
    return ["b", f"w={token.lower()[:24]}", f"s={shape(token)}", f"e={token[-1:] if not token[-1:].isalnum() else ''}", f"m={kinds}{mixed}", f"h={re.sub('[^a-z=:]', '', token.lower())[:9]}" if re.search("[=:]", token) else "h="]


@dataclass
class Field:
    """Weights: for each known feature and each of the places before, at, after a token, a score per label."""

    index: dict[str, int]
    weights: np.ndarray  # features x 3 x labels
    transition: np.ndarray  # from x to

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), 3, len(LABELS)))
        get = self.index.get
        plain: dict[tuple, np.ndarray] = {}
        for i, t in enumerate(tokens):
            if m := _PLAIN.fullmatch(t):  # such words differ in these three respects and in the word itself
                key = (bool(m[1]), bool(_SMALL.search(m[2])), m[3])
                if (row := plain.get(key)) is None:
                    row = plain[key] = self.weights[[k for f in features(t) if not f.startswith("w=") and (k := get(f)) is not None]].sum(0)
                out[i] = row
                if (k := get(f"w={t.lower()[:24]}")) is not None:
                    out[i] += self.weights[k]
            else:
                out[i] = self.weights[[k for f in features(t) if (k := get(f)) is not None]].sum(0)
        return out


#: one capital at most, small letters, a full stop or comma at most
_PLAIN = re.compile(r"([A-Z]?)([^\W\d_A-Z]+)([.,]?)")
_SMALL = re.compile("[a-z]")


def train_field(rows: list[tuple[int, int, str, str]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Maximum likelihood with AdaGrad, sentence by sentence."""
    sentences: dict[int, list[tuple[str, str]]] = {}
    for s, _, token, label in sorted(rows, key=lambda r: r[:2]):
        sentences.setdefault(s, []).append((token, label))
    counts: dict[str, int] = {}
    for own in sentences.values():
        for token, _ in own:
            for f in features(token):
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(f for f, n in counts.items() if n > 2)}
    k = len(LABELS)
    w, tr = np.zeros((len(index), 3, k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-2), np.full_like(tr, 1e-2)
    data = [([[index[f] for f in features(t) if f in index] for t, _ in own], np.array([LABELS.index(x) for _, x in own])) for own in sentences.values()]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            feats, y = data[i]
            n = len(y)
            rows_ = np.array([w[f].sum(0) for f in feats])
            emit = rows_[:, 1].copy()
            emit[1:] += rows_[:-1, 0]
            emit[:-1] += rows_[1:, 2]
            alpha, beta = np.zeros((n, k)), np.zeros((n, k))
            alpha[0] = emit[0]
            for t in range(1, n):
                alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + tr, 0) + emit[t]
            for t in range(n - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(tr + (emit[t + 1] + beta[t + 1])[None], 1)
            z = np.logaddexp.reduce(alpha[-1])
            d = np.exp(alpha + beta - z)
            d[np.arange(n), y] -= 1
            dt = np.zeros((k, k))
            for t in range(1, n):
                dt += np.exp(alpha[t - 1][:, None] + tr + (emit[t] + beta[t])[None] - z)
                dt[y[t - 1], y[t]] -= 1
            for t, f in enumerate(feats):
                g = np.zeros((3, k))
                g[1] = d[t]
                if t + 1 < n:
                    g[0] = d[t + 1]
                if t:
                    g[2] = d[t - 1]
                g = g[None] + decay * w[f]
                gw[f] += g * g
                w[f] -= rate * g / np.sqrt(gw[f])
            gt += dt * dt
            tr -= rate * dt / np.sqrt(gt)
    return Field(index, w, tr)


@functools.lru_cache(1)
def default_field() -> Field:
    return train_field(labelled_rows())


class Tagger:
    """Labels lines; remembers the scores of the tokens met in a task, in about ``limit`` bytes before it starts afresh."""

    def __init__(self, field: Field, limit: int = 64_000_000):
        self.field, self.limit = field, limit
        self.forget()

    def forget(self) -> None:
        self._row: dict[str, int] = {}
        self._table, self._bytes = np.zeros((1024, 3, len(LABELS)), np.float32), 0

    def _rows(self, tokens: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self._row.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = list({tokens[i] for i in missing.tolist()})
            size = memo_bytes(new)
            if self._bytes + size > self.limit and self._row:
                self.forget()
                return self._rows(tokens)
            self._bytes += size
            n = len(self._row)
            while n + len(new) > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[n : n + len(new)] = self.field.token_rows(new)
            self._row.update(zip(new, range(n, n + len(new)), strict=True))
            rows[missing] = [self._row[tokens[i]] for i in missing.tolist()]
        return rows

    def labels(self, tokens: list[str], lengths: np.ndarray) -> np.ndarray:
        """The best labels of all lines, whose tokens stand in a row; ``lengths``: tokens of each line, none empty."""
        rows = self._rows(tokens)
        n = len(tokens)
        if not n:
            return np.zeros(0, np.int8)
        own = self._table[rows]
        starts = np.cumsum(lengths) - lengths
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[starts], last[starts + lengths - 1] = True, True
        emit = own[:, 1].copy()
        emit[1:] += np.where(first[1:, None], 0, own[:-1, 0])
        emit[:-1] += np.where(last[:-1, None], 0, own[1:, 2])
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        transition = self.field.transition.astype(np.float32)
        back = np.zeros((n, len(LABELS)), np.int8)
        alpha = emit[starts]
        ends = np.empty((len(starts), len(LABELS)), np.float32)
        active = [len(starts)]
        for t in range(1, int(lengths[0])):
            now = int(np.searchsorted(-lengths, -t, "left"))  # lines longer than t
            ends[now : active[-1]] = alpha[now:]
            active.append(now)
            at = starts[:now] + t
            scores = alpha[:now, :, None] + transition
            choice = scores.argmax(1)
            back[at] = choice
            alpha = np.take_along_axis(scores, choice[:, None], 1)[:, 0] + emit[at]
        ends[: active[-1]] = alpha
        out = np.zeros(n, np.int8)
        label = ends.argmax(1)
        out[starts + lengths - 1] = label
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            out[at - 1] = back[at, out[at]]
        return out


_TOKEN = re.compile(r"\S+")
_PART = re.compile(r"""[^"'=:]+""")


def _trimmed(kind: str, text: str, a: int, b: int) -> tuple[str, int, int] | None:
    """The span without what surrounds it: marks, quotes, and of a secret all but its longest part between = : and quotes.

    None if what remains is no longer of the kind: a name needs two letters with a capital in front and has four words at
    most, none of them twice; a number of social security needs nine digits, a secret eight characters.
    """
    if kind == "secret":
        parts = [m.span() for m in _PART.finditer(text, a, b)]
        if not parts:
            return None
        a, b = max(parts, key=lambda p: p[1] - p[0])
    while a < b and not text[b - 1].isalnum():
        b -= 1
    while a < b and not text[a].isalnum():
        a += 1
    own = text[a:b]
    words = own.split()
    good = {"name": len(own) > 1 and own[:1].isupper() and len(words) <= 4 and len(set(words)) == len(words), "ssn": sum(map(str.isdigit, own)) == 9, "secret": len(own) >= 8}[kind]
    return (kind, a, b) if good else None


def field_spans(tagger: Tagger, texts: list[str], taken: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text, by start, cut where they meet one of ``taken`` (the base spans)."""
    tokens: list[str] = []
    lengths: list[int] = []
    lines: list[tuple[int, int]] = []  # text, offset of the line
    for i, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            own = line.split()
            if own:
                tokens += own
                lengths.append(len(own))
                lines.append((i, at))
            at += len(line) + 1
    labels = tagger.labels(tokens, np.array(lengths, np.int64))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    hit = np.flatnonzero(labels)
    if len(hit):
        ends = np.cumsum(lengths)
        which = np.searchsorted(ends, hit, "right")
        for k in np.unique(which).tolist():
            i, at = lines[k]
            text = texts[i]
            stop = text.find("\n", at)
            begin = int(ends[k]) - lengths[k]
            held: list[tuple[str, int, int]] = []
            for j, m in enumerate(_TOKEN.finditer(text, at, len(text) if stop < 0 else stop)):
                kind = LABELS[labels[begin + j]]
                if kind != "O":
                    joins = kind == "name" and held and held[-1][0] == "name" and text[held[-1][2] : m.start()].isspace()
                    held[-1:] = [("name", held[-1][1], m.end())] if joins else [*held[-1:], (kind, *m.span())]
            for kind, a, b in held:
                for x, y in _free(a, b, taken[i]):
                    if span := _trimmed(kind, text, x, y):
                        out[i].append(span)
    return out


def _free(a: int, b: int, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a..b outside ``taken``."""
    for _, x, y in sorted((t for t in taken if t[1] < b and a < t[2]), key=lambda t: t[1]):
        if a < x:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans and all spans, both by kind and start."""
    base = list(map(base_spans, texts))
    return [(own, own + sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))) for own, more in zip(base, field_spans(tagger, texts, base), strict=True)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Spans are kind:start:end (code points, end exclusive) by kind and start. Null texts are empty and have none; each row
    counts by itself, also repeated ones; other columns are ignored. Rows are mapped where they lie: no shuffle.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())  # some hundred features: fixed by the labelled table
    tag = uuid.uuid4().hex
    arrow = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_state(("tagger", tag), lambda: Tagger(shared.value)) as tagger:
            for batch in batches:
                texts = texts_of(batch)
                for a, b in slices(texts):
                    found = all_spans(tagger, texts[a:b])
                    counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
                    digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), *counts, digest, pa.array([_joined(every) for _, every in found], pa.string()), pa.array([len(every) for _, every in found], pa.int64())], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of text replaced by its kind in brackets; all columns and rows stay, null texts too.

    ``n_chars``, where there is such a column, is the new length.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    tag = uuid.uuid4().hex
    names, fields = docs.columns, pa_fields(docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_state(("tagger", tag), lambda: Tagger(shared.value)) as tagger:
            for batch in batches:
                given, texts = batch.column("text").to_pylist(), texts_of(batch)
                for a, b in slices(texts):
                    out: list[str | None] = []
                    for text, (_, spans) in zip(texts[a:b], all_spans(tagger, texts[a:b]), strict=True):
                        parts, at = [], 0
                        for kind, x, y in sorted(spans, key=lambda s: (s[1], -s[2])):
                            if x >= at:
                                parts += [text[at:x], f"[{kind}]"]
                            at = max(at, y)
                        out.append("".join([*parts, text[at:]]) if parts else text)
                    out = [None if g is None else t for g, t in zip(given[a:b], out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(out, f.type) if f.name == "text" else batch.column(f.name).slice(a, b - a).cast(f.type) for f in fields], schema=pa.schema(fields))

    masked = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents; null texts are empty and have none."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
