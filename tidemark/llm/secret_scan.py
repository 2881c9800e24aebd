"""Secret scans: rules, and a character convolutional network over every candidate with its context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import least_keyed, sample_key, staged
from tidemark.llm.spans import Span, apart, digest, listed, ordered

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.-]{6,}+={0,2}")
DIGIT = re.compile(r"[0-9]")
MIXED = re.compile(r"[a-z][A-Z]")
#: Texts that can hold a finding of the rules.
LIKELY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
#: Runs that are no secret: numbers, dates and addresses, words, names of hosts and files.
HARMLESS = re.compile(r"[0-9./_-]+|[A-Za-z][a-z]*[.=/_-]*|[A-Z]+[.=/_-]*|[A-Za-z]+(?:[./_-][A-Za-z]+)*\.?[0-9]{0,3}|[A-Za-z-]+[0-9]{0,3}(?:\.[A-Za-z]+)+")
#: Words that announce a secret: runs of letters alone are candidates after one of them.
TOLD = re.compile(r"(?i:pass|pwd|secret|token|key|credential|login|auth)[a-z]{0,6}")
#: What stands before a secret that the rules miss, and before words and numbers that are none.
CUES = ["pwd is ", "passphrase: ", "credential ", "auth=", "key -> \"", "use ", "login with '", "password is ", "the key ", "Secret> ", "(", ""]
#: What stands after either.
AFTERS = ["", " token = ", "\n", ", ", ") ", ": "]
BEFORE, AFTER, LONGEST, WIDTH = 16, 8, 96, 5
NEAR, UNWORDLY = 12, 16


def base_spans(text: str) -> list[Span]:
    """Rule matches, leftmost and non-overlapping for each kind; a match that fails its check is dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(out, KINDS)


def candidates(text: str) -> list[Span]:
    """Every run of 6 or more key characters that isn't shaped as a word alone, with the kind it is most like: what the rules find is
    among them, and their near misses too. A run has a digit, changes from small to capital letters or has UNWORDLY characters or
    more; or it follows a quotation mark, an equals sign or a colon, or stands within NEAR characters after a word that announces a secret."""
    out: list[Span] = []
    told_until = [m.end() + NEAR for m in TOLD.finditer(text)]
    last, at = -1, 0
    for m in RUN.finditer(text):
        run, a = m[0], m.start()
        while at < len(told_until) and told_until[at] - NEAR <= a:
            last, at = told_until[at], at + 1
        before = text[max(0, a - 3) : a].rstrip(" \"'")
        told = before[-1:] in ("=", ":") and before
        if told or a <= last or len(run) >= UNWORDLY or DIGIT.search(run) or MIXED.search(run) or (a and text[a - 1] in "\"'"):
            out.append(("assign" if told or a <= last else "access" if run.upper() == run else "hex", *m.span()))
    return out


#: Character classes: letters and digits each their own, some marks, spaces, and all else.
CLASSES = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.\"':@ ")}
OTHER, PAD = 1, 0


def encoded(text: str, a: int, b: int) -> np.ndarray:
    """A piece of at most LONGEST characters with its context as character classes."""
    shown = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:b] + text[b : b + AFTER]
    row = np.zeros(BEFORE + LONGEST + AFTER, np.int64)
    row[: len(shown)] = [PAD if c == "\0" else CLASSES.get(c, OTHER) for c in shown]
    return row


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """A candidate whole, or a long one as overlapping pieces that together cover it."""
    return [(i, min(b, i + LONGEST)) for i in range(a, max(a + 1, b - LONGEST // 4), LONGEST * 3 // 4)]


class Network:
    """Convolution over characters, rectified, largest and mean over places, and a logistic layer."""

    def __init__(self, filters: int = 24, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.2, (WIDTH, len(CLASSES) + 2, filters))
        self.kernel[:, PAD] = 0
        self.shift = np.zeros(filters)
        self.dense = rng.normal(0, 0.2, 2 * filters)
        self.bias = 0.0
        self.slope, self.offset, self.threshold, self.trained = 1.0, 0.0, 0.5, False

    def convolved(self, x: np.ndarray) -> np.ndarray:
        places = x.shape[1] - WIDTH + 1
        return np.maximum(sum(self.kernel[k][x[:, k : k + places]] for k in range(WIDTH)) + self.shift, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for at in range(0, len(x), 256):
            h = self.convolved(x[at : at + 256])
            out[at : at + 256] = np.concatenate((h.max(axis=1), h.mean(axis=1)), axis=1) @ self.dense + self.bias
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.offset, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, recall: float = 0.97, batch: int = 32, rate: float = 0.005, seed: int = 3) -> "Network":
        """Adam, in steps that get smaller, on two thirds; the rest calibrates the probabilities (Platt scaling) and sets the threshold:
        the highest that the share `recall` of its labelled findings reach, so no more is asked of precision than recall allows."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        cut = len(x) * 2 // 3
        learn, check = order[:cut], order[cut:]
        params = [self.kernel, self.shift, self.dense, np.zeros(1)]
        first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        epochs = int(np.clip(60_000 // max(1, len(x)), 10, 20))
        turns = epochs * -(-len(learn) // batch) + 1
        for _ in range(epochs if len(np.unique(y[learn])) == 2 else 0):
            rng.shuffle(learn)
            for at in range(0, len(learn), batch):
                rows = learn[at : at + batch]
                xb, n = x[rows], len(rows)
                h = self.convolved(xb)
                top = h.argmax(axis=1)
                f, places = h.shape[2], h.shape[1]
                pooled = np.concatenate((h.max(axis=1), h.mean(axis=1)), axis=1)
                wrong = (1 / (1 + np.exp(-np.clip(pooled @ self.dense + params[3][0], -50, 50))) - y[rows]) / n
                d_pooled = wrong[:, None] * self.dense
                d_h = np.repeat(d_pooled[:, None, f:] / places, places, axis=1)
                np.put_along_axis(d_h, top[:, None, :], np.take_along_axis(d_h, top[:, None, :], 1) + d_pooled[:, None, :f], 1)
                d_h *= h > 0
                d_kernel = np.zeros_like(self.kernel)
                shown = np.eye(len(CLASSES) + 2)[xb]
                for k in range(WIDTH):
                    d_kernel[k] = shown[:, k : k + places].reshape(n * places, -1).T @ d_h.reshape(-1, f)
                d_kernel[:, PAD] = 0
                turn += 1
                for p, g, m, v in zip(params, (d_kernel, d_h.sum(axis=(0, 1)), pooled.T @ wrong, np.array([wrong.sum()])), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (1 - turn / turns) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
                self.bias = float(params[3][0])
        self.trained = turn > 0
        if len(np.unique(y[check])) == 2:
            z, t = self.logits(x[check]), y[check]
            soft = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets
            for _ in range(200):
                p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50)))
                self.slope -= 0.2 * float(((p - soft) * z).mean() / (1 + (z * z).mean()))
                self.offset -= 0.2 * float((p - soft).mean())
            kept = np.sort(self.probabilities(x[check][t == 1]))
            self.threshold = float(kept[int(len(kept) * (1 - recall))])
        return self


#: Alphabets of keys: base 64 of either sort, base 62, 36 and 32, hexadecimal capitals.
SMALL, LARGE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = [SMALL + LARGE + DIGITS + "+/", SMALL + LARGE + DIGITS + "-_", SMALL + LARGE + DIGITS, SMALL + DIGITS, LARGE + "234567", DIGITS + "ABCDEF", LARGE + DIGITS]


def drawn(rng: np.random.Generator, alphabet: str, least: int, most: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(least, most + 1)))


def disguised(value: str, rng: np.random.Generator) -> list[str]:
    """Forms of a secret that the rules needn't find: its value as it is, in capitals, short and in groups; and keys drawn in its stead,
    long and short, from each alphabet, and in groups."""
    groups = [drawn(rng, ALPHABETS[int(k)], 4, 6) for k in rng.choice([2, 3, 5, 6], 4)]
    keys = [drawn(rng, alphabet, least, most) for alphabet in ALPHABETS for least, most in ((12, 22), (20, 44))]
    short = drawn(rng, SMALL + LARGE + DIGITS, 8, 12)
    return [value, value.upper()[:40], value[:14], "-".join(value[i : i + 5] for i in range(0, len(value), 5))[:48], "-".join(groups), *keys, *([short] if DIGIT.search(short) else [])]


def numbers(rng: np.random.Generator) -> list[str]:
    """Numbers as they stand in texts: long ones, amounts, dates, addresses and telephone numbers."""
    parts = [drawn(rng, DIGITS, 2, 4) for _ in range(4)]
    return [drawn(rng, DIGITS, 6, 24), drawn(rng, DIGITS, 14, 18), "-".join(parts[:3]), ".".join(parts), "/".join(parts[:3]), drawn(rng, DIGITS, 4, 8) + "." + parts[0]]


def names(words: list[str], rng: np.random.Generator) -> list[str]:
    """Names made of the text's own words that are no secrets although long, or with digits or capitals in them: files, variables, hosts, versions, compounds."""
    a, b, c, d, e = (words[i] for i in rng.integers(0, len(words), 5))
    n = drawn(rng, DIGITS, 1, 4)
    return [f"{a}_{b}_{n}.txt", a.lower() + b.capitalize() + c.capitalize(), f"{a.capitalize()}{b.capitalize()}{n}", f"www.{a}-{b}{n}.org/{c}", f"{a}-{n}.{n[:1]}.{n[-1:]}", f"{a.upper()}_{b.upper()}", f"{a}{n}", f"{a}/{b}/{c}.{n[:1]}", f"{a}{b}", f"{a}-{b}-{c}", f"{a}{b}{c}".lower(), f"{c}{d}{e}{a}".lower(), f"{b}{d}{e}".capitalize(), f"{a}{b}{c}".upper()]


def labelled(text: str, times: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(secrets, others) of a text as the network sees them.

    Secrets are the rules' findings (what is assigned without the name before it), and `times` times the disguised forms of each, in place of other runs
    of the text, half of them after cues that the rules don't know; small letters alone only after a cue. Others are runs of harmless form
    that no rule finds, in place and among capitals; and numbers, names and words in the same places and after the same cues. Runs of other forms have no label: a secret that the rules miss isn't taught as none. Draws are seeded by the text.
    """
    base, secret, other = base_spans(text), [], []
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
    runs = apart([("", *m.span()) for m in RUN.finditer(text)], base)
    plain = [(a, b) for _, a, b in runs if HARMLESS.fullmatch(text, a, b)]
    words = [w for a, b in plain if (w := text[a:b]).isalpha() and len(w) <= 12] or ["words"]

    def put(form: str, cue: str) -> list[np.ndarray]:
        """The form in place of one of the plain runs, after the cue, now and then among capitals: what is around secrets and others is alike."""
        a, b = plain[rng.integers(0, len(plain))] if plain else (0, len(text))
        shown, after = text[max(0, a - 40) : a] + cue, AFTERS[rng.integers(0, len(AFTERS))]
        after = cue[-1:] * (cue[-1:] in "\"'") + after + text[b : b + 2 * AFTER].lstrip("\"'")
        if rng.random() < 0.15:
            shown, after = shown.upper(), "!!" + after.upper()
        return [encoded(shown + form + after, *piece) for piece in pieces(len(shown), len(shown) + len(form))]

    def cued(share: float) -> str:
        return CUES[rng.integers(0, len(CUES))] if rng.random() < share else ""

    for kind, a, b in base:
        if kind == "assign":
            a = ASSIGN.match(text, a).start(2)
        secret += [encoded(text, *piece) for piece in pieces(a, b)]
        for _ in range(times):
            secret += [row for form in disguised(text[a:b], rng) for row in put(form, cued(0.5))]
            secret += put(drawn(rng, SMALL, 10, 24), CUES[rng.integers(0, 10)])
    asked = {(a, b) for _, a, b in candidates(text)}
    for a, b in plain:
        if (a, b) in asked:
            loud = text[max(0, a - BEFORE) : a].upper()
            other += [encoded(t, *piece) for t, k in ((text, a), (loud + text[a:b] + "!!" + text[b : b + AFTER].upper(), len(loud))) for piece in pieces(k, k + b - a)]
    for i in rng.integers(0, len(plain), 4) if plain else []:
        other += [row for form in (text[slice(*plain[i])], *numbers(rng), *names(words, rng)) for row in put(form, cued(0.5))]
    return secret, other


def evenly(rows: list, most: int) -> list:
    """At most `most` of the rows, those left out spread evenly."""
    return rows if len(rows) <= most else [rows[i] for i in np.linspace(0, len(rows) - 1, most).astype(int)]


def train(docs: DataFrame, most_texts: int = 400, most_bytes: int = 8 << 20, longest: int = 1 << 17, most_examples: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network from the labelled findings (labelled()) of at most most_texts texts with a digit that can hold one and as many others: those of
    least MD5 of id and text, none over `longest` bytes, most_bytes of each in all, most_examples of secrets and twice as many others. Findings
    are disguised up to eight times over where there are too few of them for that many examples."""
    texts = docs.where(F.octet_length(text_col) <= longest).select(sample_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    keys = staged(texts.where(F.col("text").rlike("[0-9]")).select("k", F.col("text").rlike(LIKELY).alias("likely")), "secrets-keys")  # texts are searched once
    learnt: list[str] = []
    for rows in (keys.where("likely"), keys.where("not likely")):
        chosen = F.broadcast(least_keyed(rows.select("k"), most_texts).distinct())  # at most most_texts keys
        size = 0
        for row in texts.join(chosen, "k").dropDuplicates(["k"]).orderBy("k").toLocalIterator():
            own = len(row.text.encode())
            if size + own <= most_bytes:
                size += own
                learnt.append(row.text)
    forms = len(disguised("", np.random.default_rng(0))) * max(1, sum(len(base_spans(t)) for t in learnt))
    each = [labelled(t, min(8, -(-most_examples // forms))) for t in learnt]
    secret, plain = (evenly([row for own in each for row in own[k]], most_examples * (k + 1)) for k in (0, 1))
    if not secret or not plain:
        return Network()
    return Network().fit(np.stack(secret + plain), np.array([1] * len(secret) + [0] * len(plain)))


def judged(network: Network, texts: list[str]) -> tuple[list[list[Span]], list[int]]:
    """For each text the candidates that the network finds secret, and how many it was asked about. A long candidate is as
    likely a secret as the likeliest of its pieces."""
    asked = [(i, s, piece) for i, t in enumerate(texts) for s in candidates(t) for piece in pieces(s[1], s[2])]
    found: list[dict[Span, bool]] = [{} for _ in texts]
    for at in range(0, len(asked), 1024):
        part = asked[at : at + 1024]
        p = network.probabilities(np.stack([encoded(texts[i], *piece) for i, _, piece in part]))
        for (i, s, _), q in zip(part, p.tolist(), strict=True):
            found[i][s] = found[i].get(s, False) or (network.trained and q >= network.threshold)
    return [[s for s, yes in own.items() if yes] for own in found], [len(own) for own in found]


def find(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_candidates, n_judged.

    The counts and the digest are of the rules' spans, which always stay. The network is asked about every candidate, the rules' findings
    among them: n_candidates of them, of which it finds n_judged secret; spans also lists those of these
    that overlap no rule's span. An untrained network (no finding to learn from) adds none. Null
    texts are empty; whole texts are read, long candidates too, in one pass without a shuffle. Repeated rows give repeated rows.
    A null id stays null. An empty table gives an empty result. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more, asked = judged(network, texts)
            spans = [listed(ordered(b + apart(m, b), KINDS)) for b, m in zip(base, more, strict=True)]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            sizes = [pa.array(asked, pa.int64()), pa.array([len(m) for m in more], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([digest(b) for b in base], pa.string()), pa.array(spans, pa.string()), *sizes], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_candidates", "n_judged"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, n_judged long")
