"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "-"
#: Terms that are drawn, and read, at a time.
DRAWN, READ = 64, 2048


def gamma_quantiles(count: int = 1 << 16) -> np.ndarray:
    """Gamma(2, 1) at the middle of each of `count` equal shares, by Newton's method on 1 - (1 + x) e^-x."""
    share = (np.arange(count) + 0.5) / count
    x = np.where(share < 0.3, np.sqrt(2 * share), 1 - 1.5 * np.log1p(-share))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - share) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32)


class Sampler:
    """Signatures whose collision rate is the generalised Jaccard similarity of two weighted bags.

    Terms are lower-case words; the weight of a term is its count times its characters, so that the
    similarity is about the share of text two documents have in common and short function words
    don't dominate. For each term and sample k, r and c are Gamma(2, 1) and beta is uniform on [0, 1),
    drawn by a generator seeded by the term alone, so every task draws the same. With weight w:
    t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the term of least a is the
    sample, together with its t. Each is hashed to 16 bits, so unequal samples collide once in 65,536.

    Draws of recent terms are kept, at most `memory` of them (1 kB each), so the memory doesn't grow with the vocabulary.
    """

    def __init__(self, samples: int = 128, seed: int = 3, memory: int = 250_000) -> None:
        self.samples, self.seed, self.memory = samples, seed, memory
        self.at: dict[str | tuple[str, int], int] = {}
        #: ln a of each key and sample; the lowest 16 bits of the number are the sample's code.
        self.a = np.zeros((memory, samples))
        self.gamma = gamma_quantiles()
        # Work space, used again and again: fresh arrays of this size cost more than the arithmetic on them.
        self.place = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.x, self.y = np.zeros((DRAWN, samples), np.uint64), np.zeros((DRAWN, samples), np.uint64)
        self.read = np.zeros((READ, samples))

    def draw(self, keys: list) -> None:
        """Fill rows for at most DRAWN keys that have none."""
        n, k = len(keys), self.samples
        pairs = [(key, 1) if isinstance(key, str) else key for key in keys]
        seeds = np.array([xxhash.xxh64_intdigest(term, self.seed) for term, _ in pairs], np.uint64)[:, None]
        weight = np.log(np.array([count * len(term) for term, count in pairs], np.float32))[:, None]
        # One 64-bit hash (SplitMix64) for each term and sample; its four 16-bit parts are the uniforms.
        x, y = self.x[:n], self.y[:n]
        np.add(seeds, self.place, out=x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= np.right_shift(x, np.uint64(shift), out=y)
            x *= np.uint64(factor)
        x ^= np.right_shift(x, np.uint64(31), out=y)
        parts = x.view(np.uint16).reshape(n, k, 4)
        r = self.gamma[parts[:, :, 0]]
        beta = parts[:, :, 1] * np.float32(2**-16)
        # c is Gamma(2, 1) by two uniforms, since small values of it decide and need all 32 bits.
        log_c = parts[:, :, 2] + np.float32(0.5)
        log_c *= parts[:, :, 3] + np.float32(0.5)
        log_c *= np.float32(2**-32)
        np.log(log_c, out=log_c)
        np.log(np.negative(log_c, out=log_c), out=log_c)
        t = weight / r
        t += beta
        np.floor(t, out=t)
        code = (seeds.astype(np.uint32) ^ (t.view(np.uint32) * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA77)
        code >>= np.uint32(16)
        t -= beta
        t += np.float32(1)
        t *= r
        first = len(self.at)
        rows = self.a[first : first + n]
        np.subtract(log_c, t, out=rows)
        bits = rows.view(np.uint64)
        bits &= np.uint64(0xFFFFFFFFFFFF0000)
        bits |= code
        self.at.update(zip(keys, range(first, first + n), strict=True))

    def __call__(self, text: str) -> np.ndarray | None:
        """The signature of a text: uint16 codes, one a sample; None when it has no word."""
        # A term that occurs once is its own key.
        keys = [term if count == 1 else (term, count) for term, count in Counter(text.lower().split()).items()]
        if not keys:
            return None
        least = np.full(self.samples, np.inf)
        for i in range(0, len(keys), READ):
            part = keys[i : i + READ]
            rows = list(map(self.at.get, part))
            new = [k for k, row in enumerate(rows) if row is None]
            if len(self.at) + len(new) > self.memory:
                self.at.clear()
                new = range(len(part))
            for j in range(0, len(new), DRAWN):
                some, first = new[j : j + DRAWN], len(self.at)
                self.draw([part[k] for k in some])
                for k, row in zip(some, range(first, first + len(some)), strict=True):
                    rows[k] = row
            found = np.take(self.a, rows, axis=0, out=self.read[: len(rows)], mode="clip")
            np.minimum(least, np.minimum.reduce(found, axis=0), out=least)
        return (least.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)


def as_text(signature: np.ndarray | None) -> str:
    return EMPTY if signature is None else signature.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal samples of two fingerprints; two without words are alike."""
    if a == EMPTY or b == EMPTY:
        return float(a == b)
    return float(np.mean(np.frombuffer(bytes.fromhex(a), ">u2") == np.frombuffer(bytes.fromhex(b), ">u2")))


def fingerprints(docs: DataFrame, samples: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint) for each row of docs: 4 hex digits a sample, or "-" for a text without
    words (null texts are empty). Equal texts have equal fingerprints. Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(samples)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(sample(t or "")) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, samples: int = 128, rows_per_range: int = 1500, most_ranges: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is the one with the next smaller id (rows without an id come after all ids; rows of
    one id follow each other by text); after the last comes the first. The edited text has the last
    floor(n_chars / 2) characters replaced by as many of the next text's first ones, or all it has.

    The ids are cut into ranges at quantiles (at most most_ranges numbers on the driver); a window over each range
    finds the next text, and the largest id of each range is dealt out to the range above as well, so texts
    move once. One fingerprint goes along with each text. Null texts are empty. With one row, the next text is its own. Very long texts are read whole. An
    empty table gives an empty result. Other columns of docs are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = rows.count()
    if not count:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    ranges = max(1, min(most_ranges, count // rows_per_range))
    cuts = rows.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] + [1.0], 10 * ranges)).first()[0]
    cuts = np.unique(np.array(cuts, np.int64))  # the largest id of each range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(samples)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(cuts, ids)
            prints = pa.array([as_text(sample(t)) for t in batch.column(1).to_pylist()], pa.string())
            last = np.flatnonzero(cuts[at] == ids)  # these follow the range above; the largest of all follows the lowest
            take = np.concatenate((np.arange(len(ids)), last))
            to = np.concatenate((at, (at[last] + 1) % len(cuts)))
            shown = np.concatenate((np.zeros(len(ids), bool), np.ones(len(last), bool)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], names=["id", "text", "fingerprint"]).take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to.astype(np.int32)), pa.array(shown)], names=["id", "text", "fingerprint", "range", "shown"])

    dealt = rows.mapInArrow(deal, "id long, text string, fingerprint string, range int, shown boolean")
    # In a range its own rows come first, by falling id; then what is only shown to it, whose first row counts.
    order = Window.partitionBy("range").orderBy(F.col("shown"), F.col("id").desc(), F.col("text"))
    after = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where(~F.col("shown"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    ready = after.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(samples)
        for batch in batches:
            own, following = batch.column("fingerprint").to_pylist(), batch.column("next_fingerprint").to_pylist()
            edits = [as_text(sample(t)) for t in batch.column("edited").to_pylist()]
            near = pa.array([likeness(a, b) for a, b in zip(own, edits, strict=True)], pa.float64())
            nearer = pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64())
            arrays = [batch.column("id"), batch.column("n_chars"), batch.column("edited_sha256"), batch.column("fingerprint"), pa.array(edits, pa.string()), near, nearer]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    out = ready.mapInArrow(finish, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.nullif("id", F.lit(-(1 << 63)))).withColumnRenamed("id", "doc_id")
