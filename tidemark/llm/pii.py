"""Personal data: rules, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import least_keyed, sample_key, small_batches
from tidemark.llm.spans import Span, apart, digest, listed, ordered

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is taken whole or not at all, which finds what the pattern without that finds, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Marks and words of an address that is spelled out.
SPOKEN = {"at", "dot"}
ANCHOR = re.compile(r"[0-9@]+|[\[({](?:at|dot)[\])}]|(?<=\s)dot(?=\s)", re.IGNORECASE)
ADDRESS = re.compile(r"[^\s@]+\s*(?:@|[\[({]at[\])}])\s*[^\s@.\[({]+(?:(?:\.|\s*[\[({]dot[\])}]\s*)[^\s@.\[({]+)+", re.IGNORECASE)
SPELLED = re.compile(r"[^\s@]+\s+at\s+[^\s@.\[(]+(?:\s+dot\s+[^\s@.\[(]+)+", re.IGNORECASE)
TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Rule matches, leftmost and non-overlapping for each kind; a match that fails its check is dropped."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return ordered(out, KINDS)


def shape(token: str, longest: int) -> str:
    """Letters become A or a, digits 9; runs are cut to `longest`."""
    out, run = [], 0
    for c in token:
        s = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if out and out[-1] == s else 1
        if run <= longest:
            out.append(s)
    return "".join(out)


def windows(text: str, tokens: list[tuple[int, int]], around: int = 3) -> list[tuple[int, int]]:
    """Runs of tokens [from, to) around those that hold a digit, an at sign, or one or a dot spelled out: every kind of span holds one."""
    starts = np.array([a for a, _ in tokens])
    held = np.unique(np.searchsorted(starts, [m.start() for m in ANCHOR.finditer(text)], "right") - 1)
    out: list[tuple[int, int]] = []
    for i in held.tolist():
        a, b = max(0, i - around), min(len(tokens), i + around + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Crf:
    """Linear-chain CRF: emission weights for hashed word-shape features, and transition weights."""

    slots = 1 << 12

    def __init__(self) -> None:
        self.weights = np.zeros((self.slots, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    @classmethod
    def features(cls, words: list[str]) -> np.ndarray:
        """Nine features for each word: its shapes, ends and size, and the shapes beside it."""
        short = ["^", *(w.lower() if w.lower() in SPOKEN else shape(w, 1) for w in words), "$"]
        rows = []
        for i, w in enumerate(words):
            digits = sum(c.isdigit() for c in w)
            own = (f"s{short[i + 1]}", f"l{shape(w, 4)}", f"p{short[i]}", f"n{short[i + 2]}", f"pn{short[i]} {short[i + 2]}", f"d{min(digits, 20)}", f"f{shape(w[:1], 1)}{'@' in w}{w.count('.')}", f"e{shape(w[-1:], 1)}", f"t{short[i + 1]} {short[i]}")
            rows.append([zlib.crc32(f.encode()) % cls.slots for f in own])
        return np.array(rows, np.int64).reshape(-1, 9)

    def emissions(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (sequence, place, label), padded, and lengths."""
        lengths = np.array([len(f) for f in features])
        scores = np.zeros((len(features), lengths.max(), len(LABELS)))
        for i, f in enumerate(features):
            scores[i, : len(f)] = self.weights[f].sum(axis=1)
        return scores, lengths

    def fit(self, features: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, batch: int = 32, rate: float = 0.3, seed: int = 4) -> "Crf":
        """Maximum likelihood by forward-backward and Adagrad."""
        rng, order = np.random.default_rng(seed), np.arange(len(features))
        past, past_moves = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1e-3)
        k = len(LABELS)

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            most = x.max(axis=axis, keepdims=True)
            return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)

        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                scores, lengths = self.emissions([features[r] for r in rows])
                n, t_max, _ = scores.shape
                alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
                alpha[:, 0] = scores[:, 0]
                for t in range(1, t_max):
                    alpha[:, t] = scores[:, t] + lse(alpha[:, t - 1, :, None] + self.moves, 1)
                for t in range(t_max - 2, -1, -1):
                    step = lse(self.moves + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                    beta[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
                total = lse(alpha[np.arange(n), lengths - 1], 1)
                inside = np.arange(t_max)[None, :] < lengths[:, None]
                marginal = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * inside[..., None]
                d_moves = np.zeros_like(self.moves)
                for t in range(t_max - 1):
                    both = alpha[:, t, :, None] + self.moves + (scores[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]
                    d_moves += (np.exp(np.minimum(both, 0)) * (t + 1 < lengths)[:, None, None]).sum(axis=0)
                d_weights = np.zeros_like(self.weights)
                for i, r in enumerate(rows):
                    y, own = labels[r], marginal[i, : lengths[i]].copy()
                    own[np.arange(len(y)), y] -= 1
                    np.add.at(d_weights, features[r].ravel(), np.repeat(own, features[r].shape[1], axis=0))
                    np.add.at(d_moves, (y[:-1], y[1:]), -1)
                d_weights, d_moves = d_weights / n + 1e-4 * self.weights, d_moves / n + 1e-4 * self.moves
                past, past_moves = past + d_weights**2, past_moves + d_moves**2
                self.weights -= rate * d_weights / np.sqrt(past)
                self.moves -= rate * d_moves / np.sqrt(past_moves)
        return self

    def decode(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequences, by Viterbi over batches of sequences of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(features)
        order = sorted(range(len(features)), key=lambda i: len(features[i]))
        cuts = [0]
        for at in range(1, len(order)):  # at most 256 sequences and 100,000 places, padding included; a longer sequence is alone
            if at - cuts[-1] == 256 or (at - cuts[-1] + 1) * len(features[order[at]]) > 100_000:
                cuts.append(at)
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[a:b]
            if not rows:
                continue
            scores, lengths = self.emissions([features[r] for r in rows])
            n, t_max, k = scores.shape
            best, back = scores[:, 0], np.zeros((t_max, n, k), np.int8)
            for t in range(1, t_max):
                step = best[:, :, None] + self.moves
                inside = (t < lengths)[:, None]
                back[t] = np.where(inside, step.argmax(axis=1), np.arange(k))
                best = np.where(inside, step.max(axis=1) + scores[:, t], best)
            label = best.argmax(axis=1)
            path = np.zeros((n, t_max), np.int64)
            for t in range(t_max - 1, -1, -1):
                path[:, t] = label
                label = back[t, np.arange(n), label]
            for i, r in enumerate(rows):
                out[r] = path[i, : lengths[i]]
        return out


def sequences(text: str) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """(tokens, features) of each window of a text."""
    if not ANCHOR.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    return [(tokens[a:b], Crf.features([text[x:y] for x, y in tokens[a:b]])) for a, b in windows(text, tokens)]


def token_labels(tokens: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    out, last = np.zeros(len(tokens), np.int64), None
    for i, (a, b) in enumerate(tokens):
        own = next((s for s in spans if a < s[2] and s[1] < b), None)
        if own:
            out[i] = LABELS.index(("I-" if own == last else "B-") + own[0])
        last = own
    return out


def variants(kind: str, value: str) -> list[str]:
    """Forms of a finding that the rules miss: spelled out, bracketed, or with other separators."""
    if kind == "email":
        local, _, domain = value.partition("@")
        name, host = (re.sub(r"[0-9]+", "", x).strip("._%+-") or "jo" for x in (local, domain))
        spelled = [f"{x} at {y.replace('.', ' dot ')}" for x, y in ((local, domain), (name, host))]
        return [f"{local} (at) {domain}", f"{local}[at]{domain}", f"{local} @ {domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}", *spelled, f"{name} (at) {host}", f"{name}(at){host.replace('.', '(dot)')}"]
    if kind == "ip":
        return [value.replace(".", x) for x in ("[.]", "(.)", " . ", "[dot]")]
    digits = "".join(DIGIT.findall(value))
    if kind == "card":
        return [x.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for x in (".", "/", "  ", " - ")]
    return [f"00{digits}", f"+{digits[:-7]}/{digits[-7:-4]}/{digits[-4:]}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"]


def drawn(kind: str, value: str, many: int = 6) -> list[str]:
    """More such forms, of marks and groups put together at random (seeded by the value), so that the model meets the parts in many orders."""
    rng, out = random.Random(zlib.crc32(value.encode())), []
    digits = "".join(DIGIT.findall(value))
    for _ in range(many):
        gap = rng.choice(["", " "])
        if kind == "email":
            local, _, domain = value.partition("@")
            left, right = rng.choice(["()", "[]", "{}"])
            name = rng.choice([local, "".join(c for c in local if c.isalpha()) or "jo"])
            out.append(f"{name}{gap}{left}{rng.choice(['at', 'AT'])}{right}{gap}{domain.replace('.', rng.choice(['.', f'{gap}{left}dot{right}{gap}']))}")
        elif kind == "ip":
            out.append(value.replace(".", gap + rng.choice(["[.]", "(.)", "{.}", "[dot]", "(dot)"]) + gap))
        elif kind == "card":
            mark = gap + rng.choice(".-/:|_") + gap
            out.append(mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)))
        else:
            marks, area = rng.choices([" ", "-", ".", "/", " - "], k=3), digits[-10:-7]
            abroad = rng.choice(["", f"00{digits[:-10]}{marks[0]}", f"+{digits[:-10]}{marks[0]}", f"00 {digits[:-10]} "])
            out.append(f"{abroad}{rng.choice([area, f'({area})'])}{marks[1]}{digits[-7:-4]}{rng.choice([marks[2], marks[1], ''])}{digits[-4:]}")
    return out


def harmless(value: str, many: int = 4) -> list[str]:
    """Numbers that are no personal data: dates and times, amounts, ranges, versions and book numbers (seeded by the value)."""
    rng = random.Random(zlib.crc32(value.encode()) + 1)
    two, four = (lambda: f"{rng.randint(1, 28):02d}"), (lambda: str(rng.randint(1900, 2099)))
    forms = [
        f"{four()}-{two()}-{two()} {two()}:{two()}:{two()}", f"{four()}-{two()}-{two()}T{two()}:{two()}", f"{two()}.{two()}.{four()}, {two()}:{two()}", f"{two()}/{two()}/{four()}", f"{four()}-{four()}", f"{four()} {four()} {four()}",
        f"{rng.randint(1, 999)},{rng.randint(100, 999)},{rng.randint(100, 999)}.{two()}", f"{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(100, 999)}", f"{rng.random():.12f}", f"v{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}",
        f"978-{rng.randint(0, 9)}-{two()}-{rng.randint(100000, 999999)}-{rng.randint(0, 9)}", str(rng.randint(10**9, 10**17)), "meet at " + two() + ":" + two(), f"a ratio of 1:{10 ** rng.randint(9, 14)}",
    ]
    return rng.sample(forms, many)


def labelled(text: str, around: int = 40, widest: int = 60) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the windows of a text, cut to `widest` tokens: the rules' spans where they stand, and once for
    each variant of a span that the rules miss, put in its place among what is around it; and numbers that are
    no personal data in the same places."""
    base, out = base_spans(text), []

    def add(shown: str, spans: list[Span]) -> None:
        for tokens, own in sequences(shown):
            y = token_labels(tokens, spans)
            out.extend((own[i : i + widest], y[i : i + widest]) for i in range(0, len(y), widest))

    add(text, base)
    for kind, a, b in base:
        before, after = text[max(0, a - around) : a], text[b : b + around]
        if not apart([(kind, a - around, b + around)], [s for s in base if s[1:] != (a, b)]):
            continue  # another span nearby would be unlabelled
        for form in variants(kind, text[a:b]) + drawn(kind, text[a:b]):
            add(before + form + after, [(kind, len(before), len(before) + len(form))])
        for form in harmless(text[a:b]):
            add(before + form + after, [])
    return out


def train(docs: DataFrame, most_texts: int = 600, most_bytes: int = 8 << 20, longest: int = 1 << 17, most_windows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """A model from a small labelled table (labelled()): at most most_texts texts that hold a digit or an at sign, those of least MD5
    of id and text, none over `longest` bytes, most_bytes in all, and at most most_windows windows of them, left out evenly."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]") & (F.octet_length(text_col) <= longest)).select(sample_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    windows, size = [], 0
    for row in least_keyed(rows, most_texts, "text").toLocalIterator():
        own = len(row.text.encode())
        if size + own <= most_bytes:
            size += own
            windows += labelled(row.text)
    windows = windows if len(windows) <= most_windows else [windows[i] for i in np.linspace(0, len(windows) - 1, most_windows).astype(int)]
    return Crf().fit([f for f, _ in windows], [y for _, y in windows])


def plausible(kind: str, text: str) -> bool:
    """The checks of the rules hold for the model's spans too: what a rule's check has rejected doesn't come back."""
    digits = "".join(DIGIT.findall(text))
    if kind == "email":
        return bool(ADDRESS.fullmatch(text) or SPELLED.fullmatch(text))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    abroad = text.startswith("00")  # in place of the plus
    return 10 <= len(digits) - 2 * abroad <= 15 and (abroad or len(digits) < len(text))


def field_spans(crf: Crf, texts: list[str]) -> list[list[Span]]:
    """Spans that the model finds in each text."""
    each = [sequences(t) for t in texts]
    paths = iter(crf.decode([f for s in each for _, f in s]))
    out = []
    for text, own in zip(texts, each, strict=True):
        found: list[Span] = []
        for tokens, _ in own:
            names = [LABELS[y] for y in next(paths)]
            i = 0
            while i < len(names):
                kind, j = names[i][2:], i + 1
                if kind:
                    while j < len(names) and names[j] == f"I-{kind}":
                        j += 1
                    a, b = tokens[i][0], tokens[j - 1][1]
                    while a < b and not (text[a].isalnum() or text[a] in "+("):
                        a += 1
                    while a < b and not text[b - 1].isalnum():
                        b -= 1
                    if plausible(kind, text[a:b]):
                        found.append((kind, a, b))
                i = j
        out.append(ordered(found, KINDS))
    return out


def find(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the rules' spans; spans also lists those that only the model finds
    and that overlap none of the rules', if they pass the rule's own check (plausible()). Null texts are empty; whole texts are read, in one pass without a
    shuffle, very long ones too. Repeated rows give repeated rows. A null id stays null. An empty table gives an empty
    result. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = [apart(f, b) for f, b in zip(field_spans(crf, texts), base, strict=True)]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            lists = pa.array([listed(ordered(b + m, KINDS)) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([digest(b) for b in base], pa.string()), lists], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, end = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, crf: Crf, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data masked in the text, and the length (where there is such a column) set anew.
    Null texts stay null, texts without personal data stay as they are, very long ones are read whole. Rows stay as many, whatever their ids;
    an empty table stays empty, and other columns stay as they are."""
    small_batches(docs.sparkSession)
    columns, types = docs.columns, docs.schema
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            full = [t or "" for t in texts]
            base = [base_spans(t) for t in full]
            spans = [b + apart(f, b) for f, b in zip(field_spans(crf, full), base, strict=True)]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t if t is None or not s else masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = docs.mapInArrow(run, types)
    return out.withColumn(length_col, F.length(text_col).cast(types[length_col].dataType)) if length_col in columns else out
